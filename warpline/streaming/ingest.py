"""The continuous pipeline: queue folder to raw, rejected, indicator, sighting and event tables.

Messages of a micro-batch are numbered in their order of arrival, and the number of a first sighting is its indicator's id: ids
ascend over batches and the first sighting fixes source and confidence. Each micro-batch is one idempotent
unit: its tables carry batch_id, and a batch that is run again replaces its own part only.

State is the table of indicators, in hash buckets of (value, type). A batch reads the buckets of its own keys and no others, meets
them by an anti-join, as every sighting has to be kept as well, and adds to these buckets. compact() merges the parts of a bucket.

A batch that fails leaves nothing behind. It is halved until the messages that fail alone are found; they go to the table quarantine
with the error, the others are ingested, and redrive() pushes the quarantine to the queue again.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warpline.operators import ingest
from warpline.operators.ordering import PLACE_BITS, batch_first
from warpline.session import checkpointed, children, delete, exists, scratch
from warpline.sources import queue

LOG = logging.getLogger(__name__)
TABLES = {
    "raw": "seq long, value string, type string, source string, confidence int, raw_payload string, batch_id long",
    "rejected": "seq long, value string, type string, source string, reason string, batch_id long",
    "indicators": "id long, value string, type string, source string, confidence int, bucket int, batch_id long",
    "metadata": "seq long, indicator_id long, source string, confidence int, batch_id long",
    "timeline": "seq long, event_type string, event_value string, source string, batch_id long",
    "quarantine": "seq long, value string, type string, source string, confidence int, raw_payload string, error string, batch_id long",
}
#: buckets of the state; a stream keeps the number that it began with
BUCKETS = 1024
#: attempts to find the messages that fail; what is still open then is set aside as a whole, so a broken store doesn't cost an attempt a message
ATTEMPTS = 256


def bucket() -> Column:
    return F.pmod(F.xxhash64("value", "type"), F.lit(BUCKETS)).cast("int")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table; empty while no batch has a part in it."""
    path = f"{base}/{name}"
    if not any(c.startswith(("batch_id=", "bucket=")) for c in children(spark, path)):
        return spark.createDataFrame([], TABLES[name]).drop("bucket")
    return spark.read.schema(TABLES[name]).parquet(path).drop("bucket")


def known(spark: SparkSession, base: str, buckets: Iterable[int], before: int) -> DataFrame:
    """Indicators of some buckets as they were before a batch, each key once; files of other buckets are not even listed."""
    path = f"{base}/indicators"
    there = set(children(spark, path))
    found = [f"{path}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
    if not found:
        return spark.createDataFrame([], TABLES["indicators"])
    rows = spark.read.schema(TABLES["indicators"]).option("basePath", path).parquet(*found).filter(F.col("batch_id") < before)
    first = F.min_by(F.struct("source", "confidence", "bucket", "batch_id"), "id")
    return rows.groupBy("value", "type").agg(F.min("id").alias("id"), first.alias("f")).select("id", "value", "type", "f.*")


def _put(rows: DataFrame, base: str, name: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(f"{base}/{name}")


def outputs(messages: DataFrame, batch_id: int, base: str, raw: bool = True) -> dict[str, DataFrame]:
    """The rows that numbered messages add to each table."""
    spark = messages.sparkSession
    rows = ingest.judged(messages)
    own = checkpointed(ingest.indicators(rows).withColumn("bucket", bucket()))
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
    stored = known(spark, base, touched, batch_id)
    fresh = checkpointed(ingest.only_new(own, stored))
    out = {"raw": ingest.raw(messages), "timeline": ingest.discovered(messages)} if raw else {}
    return out | {"rejected": ingest.rejected(rows), "indicators": fresh, "metadata": ingest.sightings(rows, stored.select("id", "value", "type").unionByName(fresh.select("id", "value", "type")))}


def _arranged(messages: DataFrame, batch_id: int) -> DataFrame:
    """messages with seq, unique over batches, in the order of arrival."""
    if "seq" in messages.columns:
        return messages
    first = batch_first(batch_id)
    out = queue.in_order(messages, first)
    last = out.agg(F.max("seq")).first()[0]
    if last is not None and last - first >= 1 << PLACE_BITS:
        raise OverflowError("more messages in a batch than it has numbers; lower maxBytesPerTrigger")
    return out


def apply_batch(messages: DataFrame, batch_id: int, base: str, *, guard: bool = False, raw: bool = True) -> None:
    """All outputs of one batch of parsed messages."""
    with scratch(messages.sparkSession):
        _apply(messages, batch_id, base, guard, raw)


def _apply(messages: DataFrame, batch_id: int, base: str, guard: bool, raw: bool) -> None:
    rows = _arranged(ingest.guard(messages) if guard else messages, batch_id)
    _begin(rows.sparkSession, batch_id, base)
    for name, part in outputs(rows, batch_id, base, raw).items():
        if name == "indicators":
            _put(part.repartition("bucket"), base, name, batch_id, ("bucket",))  # one file a bucket
        else:
            _put(part, base, name, batch_id)


def _begin(spark: SparkSession, batch_id: int, base: str) -> None:
    """Note that a batch is being written; if it was before, its first run may have left parts that this one has none for."""
    mark = f"{base}/_begun/batch_id={batch_id}"
    if exists(spark, mark):
        undo_batch(spark, batch_id, base)
        return
    for c in children(spark, f"{base}/_begun"):  # only the last batch can run again
        delete(spark, f"{base}/_begun/{c}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def undo_batch(spark: SparkSession, batch_id: int, base: str) -> None:
    """Remove what a batch has written."""
    for name in TABLES:
        delete(spark, f"{base}/{name}/batch_id={batch_id}")
    for b in children(spark, f"{base}/indicators"):
        if b.startswith("bucket="):
            delete(spark, f"{base}/indicators/{b}/batch_id={batch_id}")


def _failing(rows: DataFrame, low: int, high: int, batch_id: int, base: str, raw: bool, error: str, left: list[int]) -> list[tuple[int, int, str]]:
    """Ranges (first, last, error) of seq that fail alone, in [low, high], which fails as a whole."""
    if low == high or left[0] <= 0:
        return [(low, high, error)]
    out, middle = [], (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        left[0] -= 1
        try:
            for part in outputs(rows.filter(F.col("seq").between(a, b)), batch_id, base, raw).values():
                part.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            out += _failing(rows, a, b, batch_id, base, raw, str(e)[:2000], left)
    return out


def guarded_batch(messages: DataFrame, batch_id: int, base: str, *, guard: bool = False, raw: bool = True) -> None:
    """apply_batch(); if it fails, the batch is undone, the messages that fail alone are set aside, and the others are ingested."""
    spark = messages.sparkSession
    with scratch(spark):
        rows = checkpointed(_arranged(ingest.guard(messages) if guard else messages, batch_id))
        aside = []
        while True:
            good = rows
            for a, b, _ in aside:
                good = good.filter(~F.col("seq").between(a, b))
            try:
                if not aside or not good.isEmpty():
                    _apply(good, batch_id, base, False, raw)
                break
            except Exception as e:  # noqa: BLE001
                LOG.exception("batch %s failed", batch_id)
                undo_batch(spark, batch_id, base)
                low, high = good.agg(F.min("seq"), F.max("seq")).first()
                # halves that pass alone but fail together: the rest is set aside as a whole
                found = _failing(good, low, high, batch_id, base, raw, str(e)[:2000], [ATTEMPTS]) if not aside else []
                aside += found or [(low, high, str(e)[:2000])]
        if aside:
            ranges = spark.createDataFrame(aside, "low long, high long, error string")  # at most ATTEMPTS + 1 rows
            bad = rows.join(F.broadcast(ranges), F.col("seq").between(F.col("low"), F.col("high")))
            _put(bad.select("seq", "value", "type", "source", "confidence", "raw_payload", "error"), base, "quarantine", batch_id)


def redrive(spark: SparkSession, base: str, queue_path: str) -> int:
    """Push what is in quarantine to the queue again, in its order, and empty the quarantine; returns how many messages went.

    If it is stopped in between, messages can come twice: then they are sightings of one indicator.
    """
    rows = table(spark, base, "quarantine")
    n = rows.count()
    if n:
        queue.push(rows, queue_path, order="seq")
        delete(spark, f"{base}/quarantine")
    return n


def compact(spark: SparkSession, base: str, before: int, parts: int = 8) -> int:
    """Merge the parts of batches under `before` in buckets with more than `parts` of them; returns how many buckets.

    Only for batches that will not run again: all but the last. If it is stopped, a key may stand twice, which known() allows for.
    """
    merged = 0
    for b in children(spark, f"{base}/indicators"):
        path = f"{base}/indicators/{b}"
        own = [c for c in children(spark, path) if c.startswith("batch_id=") and int(c[9:]) < before]
        if not b.startswith("bucket=") or len(own) <= parts:
            continue
        last = max(own, key=lambda c: int(c[9:]))
        schema = "id long, value string, type string, source string, confidence int"
        with scratch(spark) as folder:
            spark.read.schema(schema).parquet(*[f"{path}/{c}" for c in own]).dropDuplicates(["id"]).coalesce(1).write.parquet(f"{folder}/merged")
            spark.read.schema(schema).parquet(f"{folder}/merged").coalesce(1).write.mode("overwrite").parquet(f"{path}/{last}")
        for c in own:
            if c != last:
                delete(spark, f"{path}/{c}")
        merged += 1
    return merged


def start(spark: SparkSession, queue_path: str, base: str, *, once: bool = True, guard: bool = False, raw: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """once: drain what is there and stop; else a micro-batch every so often."""
    writer = queue.stream(spark, queue_path).writeStream.option("checkpointLocation", f"{base}/_checkpoint").foreachBatch(lambda df, i: guarded_batch(df, i, base, guard=guard, raw=raw))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
