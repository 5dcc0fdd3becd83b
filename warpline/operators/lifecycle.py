"""Lifecycle of campaigns: which campaign of before goes on as which cluster of now, and what changed.

A campaign's id is a digest of its first members. When a later run finds a cluster that overlaps with it, the campaign goes on under
its id; otherwise one more member would end one campaign and begin another. Extension: the documentation names the events only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.session import checkpointed, exists, new_table

MATCH = "campaign_id string, found_id string, overlap long"


def memberships(found: DataFrame) -> DataFrame:
    """(campaign_id, member) of clusters (campaign_id, indicators), each pair once."""
    return found.select("campaign_id", F.explode("indicators").alias("member")).distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """One row a campaign: its size and 128 bits of a hash of its members."""
    return rows.groupBy("campaign_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("member")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "member")).alias("h2"))


def _order(overlap: str, old: str, new: str) -> Column:
    """Comparable: the larger overlap is better, then the smaller ids."""
    return F.struct((-F.col(overlap)).alias("o"), F.col(old).alias("p"), F.col(new).alias("q"))


def match(old: DataFrame, new: DataFrame) -> DataFrame:
    """(campaign_id, found_id, overlap) of memberships (campaign_id, member) of before and now, one to one.

    The pair with the largest overlap is taken first, ties by the smaller ids, then the next of what is left: greedy, and therefore
    unique. Equal sets are matched by a hash before anything is joined by member, so members that many unchanged campaigns share cost nothing. The
    rest runs in rounds: a round takes every pair that is the best of both its ends, which the greedy order takes as well.
    """
    spark, path = old.sparkSession, new_table(old.sparkSession)
    key = ["n", "h1", "h2"]
    same_old = _sets(old).groupBy(*key).agg(F.min("campaign_id").alias("campaign_id"))
    same_new = _sets(new).groupBy(*key).agg(F.min("campaign_id").alias("found_id"))
    equal = checkpointed(same_old.join(same_new, key).select("campaign_id", "found_id", F.col("n").alias("overlap")))
    equal.write.parquet(path)
    a = old.join(equal.select("campaign_id"), "campaign_id", "left_anti")
    b = new.withColumnRenamed("campaign_id", "found_id").join(equal.select("found_id"), "found_id", "left_anti")
    open_ = checkpointed(a.join(b, "member").groupBy("campaign_id", "found_id").agg(F.count("*").alias("overlap")))
    while not open_.isEmpty():
        rank = _order("overlap", "campaign_id", "found_id")
        best_old = open_.groupBy("campaign_id").agg(F.min(rank).alias("best"))
        best_new = open_.groupBy("found_id").agg(F.min(rank).alias("best"))
        taken = open_.join(best_old, "campaign_id").filter(rank == F.col("best")).drop("best").join(best_new, "found_id").filter(rank == F.col("best")).drop("best")
        taken = checkpointed(taken.select("campaign_id", "found_id", "overlap"))
        taken.write.mode("append").parquet(path)
        open_ = checkpointed(open_.join(taken.select("campaign_id"), "campaign_id", "left_anti").join(taken.select("found_id"), "found_id", "left_anti"))
    return spark.read.schema(MATCH).parquet(path) if exists(spark, path) else spark.createDataFrame([], MATCH)


def carried_on(old: DataFrame, new: DataFrame, matched: DataFrame) -> DataFrame:
    """Memberships of now under the ids that last: a matched cluster has its campaign's id, another one its own.

    An own id that a lasting campaign holds already (it was found for other members before) gets the members' digest added.
    """
    held = matched.select(F.col("campaign_id").alias("held"))
    ids = new.select("campaign_id").distinct().join(matched.select("found_id", F.col("campaign_id").alias("lasting")), F.col("campaign_id") == F.col("found_id"), "left").drop("found_id")
    ids = ids.join(held, F.col("campaign_id") == F.col("held"), "left").join(_sets(new).select(F.col("campaign_id").alias("own"), "h1"), F.col("campaign_id") == F.col("own"))
    fresh = F.when(F.col("held").isNull(), F.col("campaign_id")).otherwise(F.concat("campaign_id", F.lit("_"), F.lower(F.hex("h1"))))
    ids = ids.select("campaign_id", F.coalesce("lasting", fresh).alias("id"))
    return new.join(ids, "campaign_id").select(F.col("id").alias("campaign_id"), "member")


def events(old: DataFrame, now: DataFrame) -> DataFrame:
    """campaign_id, event_type, event_value: what changed from memberships of before to those of now, under lasting ids."""
    was, is_ = old.select("campaign_id").distinct(), now.select("campaign_id").distinct()
    row = lambda df, kind, value: df.select("campaign_id", F.lit(kind).alias("event_type"), F.col(value).alias("event_value"))
    both = ["campaign_id", "member"]
    added = now.join(old, both, "left_anti").join(was, "campaign_id", "left_semi")
    removed = old.join(now, both, "left_anti").join(is_, "campaign_id", "left_semi")
    created, resolved = is_.join(was, "campaign_id", "left_anti"), was.join(is_, "campaign_id", "left_anti")
    out = row(created, "campaign_created", "campaign_id").unionByName(row(added, "indicator_added", "member"))
    return out.unionByName(row(removed, "indicator_removed", "member")).unionByName(row(resolved, "campaign_resolved", "campaign_id"))


def step(old: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships of now, events) from the memberships of before and the clusters (campaign_id, indicators) of now."""
    old, new = checkpointed(old), checkpointed(memberships(found))
    now = checkpointed(carried_on(old, new, match(old, new)))
    return now, events(old, now)
