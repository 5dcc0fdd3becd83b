"""The message queue: JSON records in a folder that one side appends to and a stream reads, first in, first out.

A record carries when it was pushed, by which push, and its place in it, so the order of arrival survives files,
their sizes and the tasks that read them. Records that other programs append come in the order of their file's
time, path and block, and of their place in the block.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.operators.ordering import numbered

MESSAGE = "value string, type string, source string, confidence int"
FIELDS = ("value", "type", "source", "confidence")
#: what push() adds to a record
ENVELOPE = "queued_at long, queued_by string, queue_place long"
#: bytes that one micro-batch reads at most; every record has 3 or more, so its 2^36 numbers suffice (see ordering)
BATCH_BYTES = 128 << 30


def push(records: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON text a record, appended in the order of a column of whole numbers, or else of the rows as they stand."""
    place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    own = [F.col(c) for c in FIELDS if c in records.columns]
    envelope = [F.lit(time.time_ns() // 1000).alias("queued_at"), F.lit(uuid.uuid4().hex).alias("queued_by"), place.alias("queue_place")]
    records.select(F.to_json(F.struct(*own, *envelope)).alias("value")).write.mode("append").text(path)


def _arrival(file: bool) -> Column:
    """(at, by, block, place): comparing it compares arrival."""
    if not file:
        at, by, block = F.lit(0).cast("long"), F.lit(""), F.lit(0).cast("long")
    else:
        at, by, block = F.unix_micros(F.col("_metadata.file_modification_time")), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    stamped = F.col("m.queued_at").isNotNull() & F.col("m.queued_by").isNotNull() & F.col("m.queue_place").isNotNull()
    zero = F.lit(0).cast("long")  # lines of a block: see in_order
    own = F.struct(F.col("m.queued_at").alias("at"), F.col("m.queued_by").alias("by"), zero.alias("block"), F.col("m.queue_place").alias("place"))
    return F.when(stamped, own).otherwise(F.struct(at.alias("at"), by.alias("by"), block.alias("block"), zero.alias("place")))


def parse(raw: DataFrame, file: bool = False) -> DataFrame:
    """Messages of a column `value`, with their arrival; malformed ones are lost, as a pop of the queue loses them.

    file: raw comes straight from files, whose metadata order what carries no stamp.
    """
    m = F.from_json("value", f"{MESSAGE}, {ENVELOPE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m")
    meta = [F.col("_metadata")] if file else []
    j = raw.select(F.col("value").alias("raw_payload"), m, F.from_json("value", "map<string, string>").alias("keys"), *meta)
    j = j.withColumn("arrival", _arrival(file))
    keys = F.array_except(F.map_keys("keys"), F.array(*[F.lit(f.split()[0]) for f in ENVELOPE.split(", ")]))
    return j.filter("m._bad is null and m is not null and keys is not null").select("m.value", "m.type", "m.source", "m.confidence", "raw_payload", keys.alias("keys"), "arrival")


def in_order(messages: DataFrame, first: int = 0) -> DataFrame:
    """Parsed messages with seq: first, first + 1, ... in the order of arrival.

    A task reads a block line by line, so Spark's own ids order the lines of a block, and nothing else here.
    """
    by = ["arrival", "_line"] if "arrival" in messages.columns else ["_line"]
    return numbered(messages.withColumn("_line", F.monotonically_increasing_id()), *by, first=first).drop("arrival", "_line")


def pop_all(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path), file=True)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return parse(spark.readStream.options(**{"maxBytesPerTrigger": str(BATCH_BYTES)} | options).text(path), file=True)


def depth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("depth"))
