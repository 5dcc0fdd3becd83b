"""Derived edges: RELATED_TO between indicators, BELONGS_TO_CAMPAIGN, and addresses to networks. Extension: documented, without code.

RELATED_TO is a projection of the two-sided graph of nodes and the infrastructure they hang on (hubs). A hub's weight falls with its degree, so what is
common to all counts little. Inside a hub the members stand in order of all that they hang on, and each is paired with the next SPAN
ones: members of equal or like infrastructure stand side by side, and a hub of a million members gives SPAN million pairs, not their square. Order and
neighbours come from one numbering that is sorted by range, so a hub is spread over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warpline.operators.ordering import numbered
from warpline.session import checkpointed

SPAN, BEST = 3, 3
#: kinds of edges from a node to infrastructure that others share
HUBS = ("HOSTED_BY", "REGISTERED_WITH", "RESOLVES_TO_ASN", "RESOLVES_TO_IP", "USES_NS")
EDGE = ("src_label", "src_value", "rel", "dst_label", "dst_value")


def _profile(links: DataFrame) -> DataFrame:
    """(node, profile): the hubs of a node in one text, the rarest first, so like nodes stand side by side."""
    ranked = links.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("degree", "hub"))).alias("hs"))  # a node hangs on few hubs
    return ranked.select("node", F.array_join(F.transform("hs", lambda x: x["hub"]), "\u0002").alias("profile"))


def scored_pairs(links: DataFrame, span: int = SPAN) -> DataFrame:
    """(a, b, weight, shared) with a < b of links (node, hub): pairs within `span` places of one another in a hub; weight is the sum of 1 / degree over all hubs they share."""
    links = checkpointed(links.filter("node is not null and hub is not null").distinct())
    links = checkpointed(links.join(links.groupBy("hub").agg(F.count("*").alias("degree")), "hub"))
    order = links.filter("degree > 1").join(_profile(links), "node")
    placed = checkpointed(numbered(order.select("hub", "profile", "node"), "hub", "profile", "node", name="at"))
    near = placed.select("hub", "node", F.explode(F.sequence(F.col("at") + 1, F.col("at") + span)).alias("at")).withColumnRenamed("node", "x")
    pairs = near.join(placed, ["hub", "at"]).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    # all hubs of the two, not only the one where they met: as many rows as links of the paired nodes
    a = pairs.join(links.select(F.col("node").alias("a"), "hub", "degree"), "a")
    both = a.join(links.select(F.col("node").alias("b"), "hub"), ["b", "hub"])
    return both.groupBy("a", "b").agg(F.round(F.sum(F.lit(1.0) / F.col("degree")), 9).alias("weight"), F.count("*").alias("shared"))


def related(links: DataFrame, span: int = SPAN, best: int = BEST) -> DataFrame:
    """(a, b, weight, shared): pairs that are among the `best` of one of their nodes, by weight, then by name."""
    pairs = checkpointed(scored_pairs(links, span))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))  # a node has 2 * span partners a hub at most
    top = ends.withColumn("k", rank).filter(F.col("k") <= best).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return pairs.join(top, ["a", "b"])


def hub_links(edges: DataFrame) -> DataFrame:
    """(node, hub) of the graph's domains and the infrastructure they hang on."""
    return edges.filter(F.col("rel").isin(*HUBS) & (F.col("src_label") == "Domain")).select(F.col("src_value").alias("node"), F.concat("dst_label", F.lit(":"), "dst_value").alias("hub"))


def related_edges(edges: DataFrame) -> DataFrame:
    """RELATED_TO edges between domains, in the graph's columns and with weight."""
    found = related(hub_links(edges))
    d = F.lit("Domain")
    return found.select(d.alias("src_label"), F.col("a").alias("src_value"), F.lit("RELATED_TO").alias("rel"), d.alias("dst_label"), F.col("b").alias("dst_value"), "weight")


def campaign_edges(members: DataFrame) -> DataFrame:
    """BELONGS_TO_CAMPAIGN edges of memberships (campaign_id, member)."""
    return members.distinct().select(F.lit("Indicator").alias("src_label"), F.col("member").alias("src_value"), F.lit("BELONGS_TO_CAMPAIGN").alias("rel"), F.lit("Campaign").alias("dst_label"), F.col("campaign_id").alias("dst_value"))


def network_edges(asn_facts: DataFrame) -> DataFrame:
    """Addresses to their networks, of facts (ip, asn)."""
    rows = asn_facts.filter("ip is not null and asn is not null").select("ip", "asn").distinct()
    return rows.select(F.lit("IP").alias("src_label"), F.col("ip").alias("src_value"), F.lit("RESOLVES_TO_ASN").alias("rel"), F.lit("ASN").alias("dst_label"), F.col("asn").alias("dst_value"))


def served_by(edges: DataFrame) -> DataFrame:
    """Domains to hosting providers under the documented name."""
    return edges.filter("rel = 'HOSTED_BY'").select("src_label", "src_value", F.lit("SERVED_BY").alias("rel"), "dst_label", "dst_value")
