"""Evidence signals of campaigns, computed from memberships, features, sightings and names. Extension: documented, without code.

* shared_asn, shared_nameserver, shared_hosting: one value is held by at least two members and by half of them or more.
* temporal_overlap: of all pairs of members, half or more were active (first to last sighting) at a common time.
* domain_similarity: half of the members or more are within two edits of another member.

No signal lists pairs of a campaign but those that are similar: overlaps are counted by a sorted sweep, similar names are found through their rarest grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.operators.ordering import running

GRAM, EDITS = 3, 2
FEATURES = {"shared_asn": "asn:", "shared_nameserver": "ns:", "shared_hosting": "hosting:"}


def overlaps(intervals: DataFrame, group: str) -> DataFrame:
    """group, n, pairs, overlapping: pairs of closed intervals (group, first, last) of a group that have a common point.

    Two intervals don't overlap if one ends before the other begins. A sweep over all ends and beginnings, sorted by group and time,
    gives each beginning the number of ends before it: a running sum over a table that is sorted by range, so neither a group nor a busy
    time meets in one task, and no pair is ever made. Intervals that end before they begin count as turned round; those without a bound are left out.
    """
    own = intervals.filter(F.col("first").isNotNull() & F.col("last").isNotNull()).select(F.col(group).alias("g"), F.least("first", "last").alias("first"), F.greatest("first", "last").alias("last"))
    # at one time beginnings come first, as closed intervals meet there
    marks = own.select("g", F.explode(F.array(F.struct(F.col("first").alias("t"), F.lit(0).alias("ends")), F.struct(F.col("last").alias("t"), F.lit(1).alias("ends")))).alias("m")).select("g", "m.t", "m.ends")
    swept = running(marks, ["g", "t", "ends"], "ends", "before")
    ended = swept.groupBy("g").agg(F.sum(F.when(F.col("ends") == 0, F.col("before"))).alias("s"), F.min("before").alias("base"), F.count_if(F.col("ends") == 0).alias("n"))
    apart = F.col("s") - F.col("n") * F.col("base")  # the sum runs on over groups; base is where this group began
    pairs = F.floor(F.col("n") * (F.col("n") - 1) / 2)
    return ended.select(F.col("g").alias(group), "n", pairs.alias("pairs"), (pairs - apart).alias("overlapping"))


def _grams(text: Column) -> Column:
    """The distinct grams of a text with its ends marked; text of any length has one at least."""
    marked = F.concat(F.lit("\u0002" * (GRAM - 1)), text, F.lit("\u0003" * (GRAM - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - GRAM + 1), lambda i: F.substring(marked, i, F.lit(GRAM))))


def _deleted(text: Column, edits: int) -> Column:
    """What is left of a text after up to so many deletions."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(text)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, without))))
    return out


def similar(rows: DataFrame, group: str, edits: int = EDITS) -> DataFrame:
    """(group, a, b) with a < b: distinct texts (group, text) of a group within so many edits of one another.

    An edit touches GRAM grams at most, so two such texts lack no more than edits * GRAM of each other's distinct grams, and share one of the
    edits * GRAM + 1 rarest of each, if they share any. Texts too short for that meet through what is left after as many
    deletions. Candidates are verified by the exact edit distance.
    """
    own = rows.filter(F.col("text").isNotNull()).select(F.col(group).alias("g"), "text").distinct()
    gram = own.select("g", "text", F.explode(_grams(F.col("text"))).alias("q"))
    often = gram.groupBy("g", "q").agg(F.count("*").alias("n"))
    first = gram.join(often, ["g", "q"]).groupBy("g", "text").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "q"))), 1, edits * GRAM + 1).alias("qs"))
    index = first.select("g", "text", F.explode("qs").alias("q")).select("g", "text", "q.q")
    short = own.filter(F.length("text") + GRAM - 1 <= edits * GRAM)
    index = index.unionByName(short.select("g", "text", F.explode(_deleted(F.col("text"), edits)).alias("q")).withColumn("q", F.concat(F.lit("\u0004"), "q")))
    near = F.abs(F.length("a.text") - F.length("b.text")) <= edits
    both = index.alias("a").join(index.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.text") < F.col("b.text")) & near)
    pairs = both.select(F.col("a.g").alias(group), F.col("a.text").alias("a"), F.col("b.text").alias("b")).distinct()
    return pairs.filter(F.levenshtein("a", "b", edits) >= 0)


def shared(members: DataFrame, features: DataFrame) -> DataFrame:
    """campaign_id and FEATURES of memberships (campaign_id, member) and features (member, fp)."""
    size = members.groupBy("campaign_id").agg(F.count("*").alias("n"))
    held = members.join(features, "member").select("campaign_id", F.explode("fp").alias("f")).groupBy("campaign_id", "f").agg(F.count("*").alias("k"))
    most = held.groupBy("campaign_id").agg(*[F.max(F.when(F.startswith("f", F.lit(tag)), F.col("k"))).alias(name) for name, tag in FEATURES.items()])
    yes = lambda c: F.coalesce((F.col(c) >= 2) & (2 * F.col(c) >= F.col("n")), F.lit(False)).alias(c)
    return size.join(most, "campaign_id", "left").select("campaign_id", "n", *[yes(c) for c in FEATURES])


def signals(members: DataFrame, features: DataFrame, sightings: DataFrame) -> DataFrame:
    """campaign_id and all signals; members (campaign_id, member), features (member, fp), sightings (member, at)."""
    members = members.distinct()
    times = sightings.groupBy("member").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    time = overlaps(members.join(times, "member"), "campaign_id")
    close = similar(members.select("campaign_id", F.lower("member").alias("text")), "campaign_id")
    ends = close.select("campaign_id", F.col("a").alias("text")).unionByName(close.select("campaign_id", F.col("b").alias("text"))).distinct()
    alike = ends.groupBy("campaign_id").agg(F.count("*").alias("k"))
    out = shared(members, features).join(time.select("campaign_id", "pairs", "overlapping"), "campaign_id", "left").join(alike, "campaign_id", "left")
    overlap = F.coalesce((F.col("pairs") > 0) & (2 * F.col("overlapping") >= F.col("pairs")), F.lit(False))
    return out.select("campaign_id", *FEATURES, overlap.alias("temporal_overlap"), F.coalesce(2 * F.col("k") >= F.col("n"), F.lit(False)).alias("domain_similarity"))
