"""Campaigns from clusters: stable ids, new against stored, scores, events, attribution, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.functions import columns as C

#: fixed values: actor profiles in order
ACTORS = (("APT29", ["Namecheap"], ["AS13335"], ["T1566", "T1071"]), ("Lazarus", ["GoDaddy"], ["AS20940"], ["T1105"]))
#: documented weights of evidence
EVIDENCE = {"shared_asn": 0.25, "shared_nameserver": 0.20, "shared_hosting": 0.15, "temporal_overlap": 0.10, "domain_similarity": 0.20}


def identified(clusters: DataFrame) -> DataFrame:
    """campaign_id, indicators, size, campaign_key of clusters with a column indicators."""
    i = F.col("indicators")
    return clusters.select(C.campaign_id(i).alias("campaign_id"), "indicators", F.size(i).alias("size"), C.campaign_key(i).alias("campaign_key"))


def new_rows(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to insert: unknown campaigns once, at the fixed first rating. Keys decide, so two campaigns whose ids collide are both kept."""
    fresh = found.join(stored.select("campaign_key"), "campaign_key", "left_anti").dropDuplicates(["campaign_key"])
    return fresh.select("campaign_id", F.lit(60).alias("confidence"), F.lit("emerging").alias("strength"), F.col("size").alias("indicator_count"), "campaign_key")


def created_events(new: DataFrame) -> DataFrame:
    return new.select("campaign_id", F.lit("campaign_created").alias("event_type"), F.col("campaign_id").alias("event_value"), F.lit("campaign_engine").alias("source"))


def with_status(found: DataFrame, stored: DataFrame) -> DataFrame:
    known = stored.select("campaign_key", F.lit(True).alias("known")).distinct()
    return found.join(known, "campaign_key", "left").withColumn("status", F.when(F.col("known"), "existing").otherwise("new")).drop("known")


def scored(found: DataFrame) -> DataFrame:
    s = C.score(F.col("indicators"))
    return found.withColumn("confidence", s).withColumn("strength", C.strength(F.col("confidence")))


def materialised(scored_: DataFrame) -> DataFrame:
    return scored_.select("campaign_id", "confidence", "strength", F.col("size").alias("indicator_count"))


def with_infrastructure(found: DataFrame, features: DataFrame) -> DataFrame:
    """Clusters with registrar and asn: what most members have, of equals the smaller; features are (member, fp)."""
    held = found.select("campaign_id", F.explode("indicators").alias("member")).join(features, "member").select("campaign_id", F.explode("fp").alias("f"))
    counted = held.groupBy("campaign_id", "f").agg(F.count("*").alias("k"))
    most = lambda tag: F.substring(F.min(F.when(F.startswith("f", F.lit(tag)), F.struct((-F.col("k")).alias("k"), F.col("f").alias("f"))))["f"], len(tag) + 1, 2000)
    best = counted.groupBy("campaign_id").agg(most("registrar:").alias("registrar"), most("asn:").alias("asn"))
    return found.join(best, "campaign_id", "left")


def actors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(ACTORS)], "ord int, actor string, registrars array<string>, asns array<string>, techniques array<string>")


def actor_scores(rows: DataFrame) -> DataFrame:
    """Every campaign (campaign_id, indicators, registrar, asn) against every actor: 0.3, 0.3 and 0.2 a technique."""
    found = rows.withColumn("seen", C.technique(F.try_element_at("indicators", F.lit(1)), C.DOMAIN_KEYWORDS))
    both = found.crossJoin(F.broadcast(actors(rows.sparkSession)))  # a constant of two rows
    hit = lambda a, v: F.coalesce(F.array_contains(a, F.col(v)), F.lit(False)).cast("double") * 0.3
    total = F.lit(0.0) + hit("registrars", "registrar") + hit("asns", "asn") + F.size(F.array_intersect("seen", "techniques")) * 0.2
    return both.select("campaign_id", "actor", "ord", F.round(total, 6).alias("score"))


def attribution(scores: DataFrame) -> DataFrame:
    """The best actor; ties, and campaigns without any evidence, go to the first profile."""
    best = F.max_by(F.struct("actor", "score"), F.struct("score", -F.col("ord")))
    return scores.groupBy("campaign_id").agg(best.alias("b")).select("campaign_id", "b.actor", "b.score")


def feed_status(runs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Upsert of feed runs (name, count, success, seq): the last run of each name, over the stored rows."""
    last = F.max_by(F.struct("count", "success"), F.col("seq"))
    new = runs.groupBy("name").agg(last.alias("r")).select("name", F.col("r.count").alias("indicators_collected"), F.when(F.col("r.success"), "success").otherwise("failed").alias("status"))
    if stored is None:
        return new
    kept = stored.join(new.select("name"), "name", "left_anti").select("name", "indicators_collected", "status")
    return kept.unionByName(new)


def evidence(pairs: DataFrame) -> DataFrame:
    """Extension: weighted confidence of documented signals, each a boolean column."""
    total = sum((F.coalesce(F.col(k), F.lit(False)).cast("double") * w for k, w in EVIDENCE.items()), F.lit(0.0))
    return pairs.withColumn("evidence_score", F.round(total, 6))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
