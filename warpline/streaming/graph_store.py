"""The graph kept up to date: what a run adds or takes away changes the hash buckets it falls into, and no others.

An edge stands with the number of indicators that state it and goes when none is left. Each bucket's file names the run that wrote it
last, so a run that was stopped half-way and begins again passes over the buckets that it has done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.operators import graph
from warpline.session import checkpointed, children, scratch

EDGE = ["src_label", "src_value", "rel", "dst_label", "dst_value"]
OWN = ["label", "value", "id", "type", "source", "confidence"]
KINDS = {"edges": (EDGE, [f"{c} string" for c in EDGE]), "own": (OWN, ["label string", "value string", "id long", "type string", "source string", "confidence int"])}


class GraphStore:
    """Tables edges and own (what each indicator says of its node) below a folder, in hash buckets."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 256):
        self.spark, self.base, self.buckets = spark, base, buckets

    def _schema(self, kind: str) -> str:
        return ", ".join([*KINDS[kind][1], "refs long", "run long", "bucket int"])

    def _rows(self, kind: str, buckets: set[int] | None = None) -> DataFrame:
        path = f"{self.base}/{kind}"
        there = [c for c in children(self.spark, path) if c.startswith("bucket=") and (buckets is None or int(c[7:]) in buckets)]
        if not there:
            return self.spark.createDataFrame([], self._schema(kind))
        return self.spark.read.schema(self._schema(kind)).option("basePath", path).parquet(*[f"{path}/{c}" for c in there])

    def _apply(self, kind: str, delta: DataFrame, run: int) -> set[int]:
        """Add delta (with refs) to its buckets; returns those that were written."""
        key = KINDS[kind][0]
        placed = checkpointed(delta.groupBy(*key).agg(F.sum("refs").alias("refs")).filter("refs <> 0").withColumn("bucket", F.pmod(F.xxhash64(*key[:2]), F.lit(self.buckets)).cast("int")))
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}  # at most the number of buckets
        old = self._rows(kind, touched)
        done = {r.bucket for r in old.groupBy("bucket").agg(F.max("run").alias("run")).filter(F.col("run") >= run).collect()}
        open_ = touched - done
        if not open_:
            return set()
        mine = F.col("bucket").isin(*open_)
        both = old.filter(mine & (F.col("refs") > 0)).select(*key, "bucket", "refs").unionByName(placed.filter(mine).select(*key, "bucket", "refs"))
        now = both.groupBy(*key, "bucket").agg(F.sum("refs").alias("refs")).filter("refs > 0")
        # a row without refs names the run, also where no edge is left
        marks = placed.filter(mine).select("bucket").distinct().select(*[F.lit(None).alias(c) for c in key], "bucket", F.lit(0).cast("long").alias("refs"))
        out = checkpointed(now.unionByName(marks).withColumn("run", F.lit(run).cast("long")))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.base}/{kind}")
        return open_

    def apply(self, run: int, added: tuple[DataFrame, DataFrame], removed: tuple[DataFrame, DataFrame] | None = None) -> dict[str, set[int]]:
        """Take in (indicators, enriched) and take away others, each as they were taken in; runs have ascending numbers. Returns the buckets written."""
        with scratch(self.spark):
            edges, own = [], []
            for sign, part in ((1, added), (-1, removed)):
                if part is None:
                    continue
                ind = part[0]
                edges.append(graph.stated(*part).distinct().groupBy(*EDGE).agg((F.count("*") * sign).alias("refs")))
                own.append(ind.select(graph.label(F.col("type")).alias("label"), "value", "id", "type", "source", "confidence", F.lit(sign).cast("long").alias("refs")))
            both = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            return {"edges": self._apply("edges", both(edges), run), "own": self._apply("own", both(own), run)}

    def edges(self) -> DataFrame:
        return self._rows("edges").filter("refs > 0").select(*EDGE)

    def nodes(self) -> DataFrame:
        """Every end of an edge once; an indicator's own node has the properties of its last writer."""
        rows = self._rows("own").filter("refs > 0")
        props = F.max_by(F.struct("type", "source", "confidence"), F.col("id"))
        own = rows.groupBy("label", "value").agg(props.alias("p")).select("label", "value", "p.*")
        e = self.edges()
        ends = e.select(F.col("src_label").alias("label"), F.col("src_value").alias("value")).union(e.select("dst_label", "dst_value")).distinct()
        return ends.join(own, ["label", "value"], "left")
