"""Pivots without a full scan: postings of trigrams in hash buckets, candidates verified by LIKE.

A pattern's literal runs give trigrams that every matching value holds. Their buckets alone are read, the rarest few name the
candidates, and the rows of these, in buckets of their ids, are compared with the pattern itself. Patterns without three literal characters in a row, and
patterns with a backslash, are answered by a scan.
"""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from warpline.operators import lookup
from warpline.session import children

RARE = 3


def grams_of(text: str) -> set[str]:
    """Trigrams that every value holds which is like %text%."""
    if "\\" in text:
        return set()
    return {run[i : i + 3] for run in re.split("[%_]", text) for i in range(len(run) - 2)}


class Postings:
    """Tables rows (indicators by id), grams (gram, id) and often (gram, n) below a folder, added to run by run."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 512):
        self.spark, self.base, self.buckets = spark, base, buckets

    def _bucket(self, c: str):  # noqa: ANN202
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def append(self, indicators: DataFrame, run: int) -> None:
        """Add indicators (id, value, ...), which are new; a run that is repeated under its number replaces itself."""
        put = lambda rows, name, key: rows.withColumns({"bucket": self._bucket(key), "run": F.lit(run).cast("long")}).repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(f"{self.base}/{name}")
        put(indicators, "rows", "id")
        v = F.col("value")
        gram = F.transform(F.sequence(F.lit(1), F.length(v) - 2), lambda i: F.substring(v, i, F.lit(3)))
        one = indicators.filter(F.length(v) >= 3).select("id", F.explode(F.array_distinct(gram)).alias("gram"))
        put(one, "grams", "gram")
        put(one.groupBy("gram").agg(F.count("*").alias("n")), "often", "gram")

    def _read(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        path = f"{self.base}/{name}"
        there = [c for c in children(self.spark, path) if c.startswith("bucket=") and (buckets is None or int(c[7:]) in buckets)]
        rows = self.spark.read.option("basePath", path).parquet(*[f"{path}/{c}" for c in there]) if there else None
        return rows if rows is None else rows.drop("bucket", "run")

    def _buckets_of(self, values: list, kind: str) -> set[int]:
        rows = self.spark.createDataFrame([(v,) for v in values], f"v {kind}")
        return {r.b for r in rows.select(self._bucket("v").alias("b")).distinct().collect()}

    def pivot(self, text: str) -> DataFrame:
        """The indicators whose value is like %text%, as lookup.pivot_domain answers."""
        grams = grams_of(text)
        if not grams:
            return lookup.pivot_domain(self._read("rows"), text)
        counts = self._read("often", self._buckets_of(sorted(grams), "string"))
        empty = lambda: self._read("rows").limit(0)
        if counts is None:
            return empty()
        # at most as many rows as the pattern has trigrams
        n = {r.gram: r.n for r in counts.filter(F.col("gram").isin(*grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if set(n) != grams:
            return empty()
        rare = sorted(grams, key=lambda g: (n[g], g))[:RARE]
        hits = self._read("grams", self._buckets_of(rare, "string")).filter(F.col("gram").isin(*rare))
        ids = hits.groupBy("id").agg(F.count("*").alias("k")).filter(F.col("k") == len(rare)).select("id")
        buckets = {r.b for r in ids.select(self._bucket("id").alias("b")).distinct().collect()}  # at most the number of buckets
        rows = self._read("rows", buckets) if buckets else None
        return empty() if rows is None else lookup.pivot_domain(rows.join(ids, "id", "left_semi"), text)
