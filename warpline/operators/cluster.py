"""Fingerprints, Jaccard pairs and greedy leader clustering.

Clustering works on distinct fingerprints in order of their first place. Adjacent pairs come from an
inverted index on the rarest features only (prefix filter), with a size filter, and are verified. Leaders
are the lexicographically first maximal independent set, found in rounds: a fingerprint whose earlier
neighbours are all covered leads, and its later neighbours are covered. There are as many rounds as the longest
chain of undecided neighbours in order of arrival: few for a random order, up to the length of a chain
of fingerprints that each resemble only the one before.
Published method: Blelloch, Fineman, Shun, SPAA 2012. Leaders keeps this up to date as values arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions import columns as C
from warpline.session import checkpointed, children, delete, exists, new_table, scratch


def fingerprint(enriched: DataFrame, *keep: str) -> DataFrame:
    """keep columns and fp: the sorted distinct tagged features; empty strings do not count."""
    tag = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(name), F.col(c)))
    ns = F.transform(F.coalesce(C.split_list(F.col("nameservers")), F.array().cast("array<string>")), lambda x: F.concat(F.lit("ns:"), x))
    fixed = F.array_compact(F.array(tag("asn:", "asn"), tag("registrar:", "registrar"), tag("hosting:", "hosting_provider")))
    return enriched.select(*keep, F.array_sort(F.array_distinct(F.concat(fixed, ns))).alias("fp"))


def by_value(enriched: DataFrame, indicators: DataFrame) -> DataFrame:
    """pos, value, fp: a value under two types keeps its first place and its last enrichment."""
    ind = indicators.select(F.col("id").alias("indicator_id"), "value")
    rows = fingerprint(enriched.join(ind, "indicator_id"), "indicator_id", "value")
    return rows.groupBy("value").agg(F.min("indicator_id").alias("pos"), F.max_by("fp", "indicator_id").alias("fp")).select("pos", "value", "fp")


def ranks(fps: DataFrame) -> DataFrame:
    """(f, n): how many of the fingerprints (fp) hold each feature; fixes the order of features, the rarest first."""
    return fps.select(F.explode("fp").alias("f")).groupBy("f").agg(F.count("*").alias("n"))


def _ranked(fps: DataFrame, ranks_: DataFrame) -> DataFrame:
    """(pos, fs): features in their fixed order; those without a rank come first."""
    feature = fps.select("pos", F.explode("fp").alias("f")).join(ranks_, "f", "left")
    own = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "f")))
    return feature.groupBy("pos").agg(own.alias("fs")).select("pos", F.transform("fs", lambda x: x["f"]).alias("fs"))


def _indexed(ranked: DataFrame) -> DataFrame:
    """(pos, fs, f): sets with J >= 3/4 share one of the floor(size / 4) + 1 first features of each, whatever the order, if it is one."""
    first = (F.floor(F.size("fs") / 4) + 1).cast("int")
    return ranked.select("pos", "fs", F.explode(F.slice("fs", F.lit(1), first)).alias("f"))


def _close(a: DataFrame, b: DataFrame, later: bool) -> DataFrame:
    """(a, b) of entries of two indexes with a similarity of 3/4 or more; later: with a.pos < b.pos."""
    a, b = a.alias("a"), b.alias("b")
    near = (F.col("a.f") == F.col("b.f")) & (4 * F.size("a.fs") >= 3 * F.size("b.fs")) & (4 * F.size("b.fs") >= 3 * F.size("a.fs"))
    both = a.join(b, near & (F.col("a.pos") < F.col("b.pos")) if later else near)
    shared = F.size(F.array_intersect("a.fs", "b.fs"))
    return both.filter(7 * shared >= 3 * (F.size("a.fs") + F.size("b.fs"))).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct()


def adjacent(fps: DataFrame) -> DataFrame:
    """(a, b) with a.pos < b.pos of distinct fingerprints (pos, fp) with a Jaccard similarity of 3/4 or more."""
    index = _indexed(_ranked(fps, ranks(fps)))
    return _close(index, index, True)


def similarity(a, b):  # noqa: ANN001, ANN201
    """Jaccard similarity of two feature arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def leaders(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """pos of the greedy leaders among items (pos) with earlier-later pairs (a, b); a round keeps only pairs of open items."""
    spark, path = items.sparkSession, new_table(items.sparkSession)
    live, open_ = checkpointed(pairs), checkpointed(items.select("pos"))
    while not open_.isEmpty():
        lead = checkpointed(open_.join(live.select(F.col("b").alias("pos")), "pos", "left_anti"))
        lead.write.mode("append").parquet(path)
        covered = live.join(lead.select(F.col("pos").alias("a")), "a", "left_semi").select(F.col("b").alias("pos"))
        open_ = checkpointed(open_.join(lead.unionByName(covered), "pos", "left_anti"))
        live = checkpointed(live.join(open_.select(F.col("pos").alias("a")), "a", "left_semi").join(open_.select(F.col("pos").alias("b")), "b", "left_semi"))
    return spark.read.schema("pos long").parquet(path) if exists(spark, path) else items.select("pos").limit(0)


def clusters(values: DataFrame) -> DataFrame:
    """(leader, member_pos, member) of values (pos, value, fp): a leader and all later items close to it.

    Members may belong to several leaders; clusters of one go; empty fingerprints are close to none.
    """
    values = checkpointed(values.filter(F.size("fp") > 0))
    distinct = checkpointed(values.groupBy("fp").agg(F.min("pos").alias("pos")))
    pairs = checkpointed(adjacent(distinct))
    return of_many(_members(values, distinct, pairs, leaders(distinct, pairs)))


def _members(values: DataFrame, distinct: DataFrame, pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """(leader, member_pos, member) of all leaders, themselves included."""
    groups = values.join(distinct.withColumnRenamed("pos", "group"), "fp").select("group", "pos", "value")
    # a fingerprint's items all have its neighbours; its own later items are at similarity 1
    near = pairs.select(F.col("a").alias("leader"), F.col("b").alias("group")).unionByName(pairs.select(F.col("b").alias("leader"), F.col("a").alias("group"))).unionByName(distinct.select(F.col("pos").alias("leader"), F.col("pos").alias("group")))
    near = near.join(lead.select(F.col("pos").alias("leader")), "leader", "left_semi")
    return near.join(groups, "group").filter(F.col("pos") >= F.col("leader")).select("leader", F.col("pos").alias("member_pos"), F.col("value").alias("member"))


def of_many(rows: DataFrame) -> DataFrame:
    """Clusters of two members or more."""
    many = rows.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1").select("leader")
    return rows.join(many, "leader", "left_semi")


class Leaders:
    """Leader clustering that grows: later values never change earlier leaders, as the order is that of arrival.

    Stored are the order of features, fixed with the first append; the leaders' index by their first features, in hash
    buckets of the feature; and the memberships. An append probes the buckets of its own features and runs its rounds on new
    fingerprints alone; no pair of older ones is read or made again. Features that came later than the order have no rank
    and stand before all others, by name: still one order for all, if a less selective one, until rebuild() takes a new one.

    A value counts once, with its first fingerprint; append() refuses a stored value that comes with another one (rebuild()
    takes the new ones) and positions that aren't after all stored ones. An append that is run again under its number replaces itself.
    """

    BUCKETS = 256
    SCHEMAS = {
        "ranks": "f string, n long",
        "index": "f string, pos long, fs array<string>, bucket int, run long",
        "members": "leader long, member_pos long, member string, run long",
        "values": "pos long, value string, fp array<string>, run long",
    }

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _read(self, name: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        path = f"{self.base}/{name}"
        there = [c for c in children(self.spark, path) if c.startswith(("run=", "bucket=", "part-"))]
        if buckets is not None:
            there = [c for c in there if c in {f"bucket={b}" for b in buckets}]
        if not there:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        reader = self.spark.read.schema(self.SCHEMAS[name]).option("basePath", path)
        rows = reader.parquet(*[f"{path}/{c}" for c in there]) if buckets is not None else reader.parquet(path)
        return rows if before is None else rows.filter(F.col("run") < before)

    def _put(self, rows: DataFrame, name: str, run: int, *by: str) -> None:
        rows.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "run").parquet(f"{self.base}/{name}")

    def last_run(self) -> int:
        """The number of the last append that came to its end; 0 before the first."""
        return max([0, *(int(c[4:]) for c in children(self.spark, f"{self.base}/values") if c.startswith("run="))])

    def members(self) -> DataFrame:
        """(leader, member_pos, member) of clusters of two or more."""
        return of_many(self._read("members").drop("run"))

    def append(self, values: DataFrame, run: int) -> None:
        """Add values (pos, value, fp); runs have ascending numbers."""
        with scratch(self.spark):
            self._append(values, run)

    def _append(self, values: DataFrame, run: int) -> None:
        stored = self._read("values", run)
        values = checkpointed(values.select("pos", "value", "fp"))
        last = stored.agg(F.max("pos")).first()[0]
        both = values.join(stored.select("value", F.col("fp").alias("old")), "value", "left")
        if not both.filter("old is not null and old <> fp").isEmpty():
            raise ValueError("a stored value came with another fingerprint; rebuild")
        values = checkpointed(both.filter("old is null").drop("old").filter(F.size("fp") > 0))
        if last is not None and not values.filter(F.col("pos") <= last).isEmpty():
            raise ValueError("values must come after all stored ones")
        if values.isEmpty():
            return
        distinct = checkpointed(values.groupBy("fp").agg(F.min("pos").alias("pos")))
        if not exists(self.spark, f"{self.base}/ranks"):
            ranks(distinct).write.parquet(f"{self.base}/ranks")
        index = checkpointed(_indexed(_ranked(distinct, self._read("ranks"))).withColumn("bucket", F.pmod(F.xxhash64("f"), F.lit(self.BUCKETS)).cast("int")))
        touched = [r.bucket for r in index.select("bucket").distinct().collect()]  # at most BUCKETS
        old = checkpointed(_close(self._read("index", run, touched), index, False))  # (leader, group)
        pairs = checkpointed(_close(index, index, True))
        free = distinct.join(old.select(F.col("b").alias("pos")), "pos", "left_anti").select("pos")
        among = pairs.join(free.withColumnRenamed("pos", "a"), "a", "left_semi").join(free.withColumnRenamed("pos", "b"), "b", "left_semi")
        lead = checkpointed(leaders(free, among))
        groups = values.join(distinct.withColumnRenamed("pos", "group"), "fp").select("group", "pos", "value")
        joined = old.select(F.col("a").alias("leader"), F.col("b").alias("group")).join(groups, "group").select("leader", F.col("pos").alias("member_pos"), F.col("value").alias("member"))
        self._put(joined.unionByName(_members(values, distinct, pairs, lead)), "members", run)
        self._put(index.join(lead, "pos", "left_semi").select("f", "pos", "fs", "bucket").repartition("bucket"), "index", run, "bucket")
        self._put(values, "values", run)

    def rebuild(self, values: DataFrame, run: int) -> None:
        """Begin anew, with a new order of features."""
        kept = values.select("pos", "value", "fp")
        with scratch(self.spark):
            kept = checkpointed(kept)
            for name in self.SCHEMAS:
                delete(self.spark, f"{self.base}/{name}")
            self._append(kept, run)


def as_arrays(rows: DataFrame) -> DataFrame:
    members = F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "member"))), lambda x: x["member"])
    return rows.groupBy("leader").agg(members.alias("indicators"))
