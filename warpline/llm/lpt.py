"""Sharding by longest-processing-time scheduling: groups that must stay together, spread to near equal bytes.

Groups are rows with equal texts. Sorted by size, the largest first, each goes to the shard with the least load,
which a heap names (Graham, 1969). Groups of at least 1 / GRAIN of a shard's mean load are scheduled one by one: there
are at most shards * GRAIN of them, whatever the corpus. Smaller groups are first put into shards * GRAIN bundles by
their hash, and a bundle is scheduled like a group. The heap thus sees a number of items that only the parameters
bound, and no shard exceeds the mean by more than its last item, which is a bundle, a group under that size, or
one group that is itself larger than the rest of its shard.

The rule is the same at every size. A row's shard depends on its text alone, so rows are placed by two joins with
tables of bounded size and never shuffled for it. Slots come from counts by input partition and shard.

Defined cases: a null text has no bytes, belongs to one group with empty texts, and has crc 0; every row has the size of
its bytes plus OVERHEAD. Repeated rows are rows of their own and stay together. Null or repeated doc_ids change
nothing, as doc_ids decide nothing. Ties of size go by the group's hash, ties of load by the smaller shard. An empty table gives an
empty result. Extra columns are not read by place(), and kept by assign() and write().
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.common import materialise

SHARDS, GRAIN, OVERHEAD = 40, 1000, 16


class Schedule(NamedTuple):
    """shard of each large group (group, shard) and of each bundle (bundle, shard), with the loads of all shards."""

    groups: DataFrame
    bundles: DataFrame
    shards: int
    grain: int
    loads: list[int]


def schedule(items: list[tuple[int, bytes]], shards: int) -> tuple[dict[bytes, int], list[int]]:
    """(shard of each key, load of each shard) of items (size, key): the largest first, always to the least load."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        out[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _group(text_col: str) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(_text(text_col)))


def _size(text_col: str) -> Column:
    return F.octet_length(_text(text_col)).cast("long") + F.lit(OVERHEAD)


def _bundle(group: Column, bundles: int) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(bundles)).cast("int")


def fit(sized: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> Schedule:
    """The schedule of rows (group, size); at most 2 * shards * grain items come to the driver."""
    spark = sized.sparkSession
    total = sized.agg(F.sum("size")).first()[0] or 0
    least = -(-total // (shards * grain))
    groups = sized.groupBy("group").agg(F.sum("size").alias("size"))
    alone = F.col("size") >= F.lit(least)
    item = groups.select(F.when(alone, F.col("group")).alias("group"), F.when(~alone, _bundle(F.col("group"), shards * grain)).alias("bundle"), "size")
    rows = item.groupBy("group", "bundle").agg(F.sum("size").alias("size")).collect()
    where, loads = schedule([(r["size"], bytes(r["group"]) if r["group"] is not None else r["bundle"].to_bytes(4, "big")) for r in rows], shards)
    own = [(bytearray(k), s) for k, s in where.items() if len(k) == 16]
    rest = [(int.from_bytes(k, "big"), s) for k, s in where.items() if len(k) == 4]
    return Schedule(spark.createDataFrame(own, "group binary, shard int"), spark.createDataFrame(rest, "bundle int, shard int"), shards, grain, loads)


def _with_shard(rows: DataFrame, plan: Schedule, group: str, shard: str) -> DataFrame:
    """Both tables have at most shards * grain rows of a few bytes, so they are broadcast."""
    own = plan.groups.select(F.col("group").alias(f"{group}_own"), F.col("shard").alias(f"{shard}_own"))
    rest = plan.bundles.select(F.col("bundle").alias(f"{group}_rest"), F.col("shard").alias(f"{shard}_rest"))
    found = rows.join(F.broadcast(own), F.col(group) == F.col(f"{group}_own"), "left").join(F.broadcast(rest), _bundle(F.col(group), plan.shards * plan.grain) == F.col(f"{group}_rest"), "left")
    return found.withColumn(shard, F.coalesce(f"{shard}_own", f"{shard}_rest")).drop(f"{group}_own", f"{group}_rest", f"{shard}_own", f"{shard}_rest")


def assign(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """docs, all columns, with the shard of each row; shard_col must be a new name."""
    if shard_col in docs.columns:
        raise ValueError(f"docs already have a column {shard_col}")
    key = "_" * (1 + max(map(len, docs.columns))) + "key"
    plan = fit(docs.select(_group(text_col).alias("group"), _size(text_col).alias("size")), shards, grain)
    out = _with_shard(docs.withColumn(key, _group(text_col)), plan, key, key + "_shard")
    return out.withColumnRenamed(key + "_shard", shard_col).drop(key)


def write(docs: DataFrame, path: str, shards: int = SHARDS, grain: int = GRAIN, text_col: str = "text", shard_col: str = "shard") -> None:
    """docs as Parquet, a folder a shard; a shard has as many files as tasks had rows of it."""
    assign(docs, shards, grain, text_col, shard_col).write.partitionBy(shard_col).parquet(path)


def place(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: the law is bytes)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _size(text_col).alias("size"), F.crc32(F.encode(_text(text_col), "UTF-8")).alias("text_crc32"), _group(text_col).alias("group"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    stored = materialise(rows)  # fixes part and row
    plan = fit(stored.select("group", "size"), shards, grain)
    placed = _with_shard(stored, plan, "group", "shard").drop("group")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    return placed.withColumn("own", own).join(first, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
