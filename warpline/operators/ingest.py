"""Ingestion: guard, schema check, reject or accept, first-wins de-duplication, sightings, events.

Messages carry seq, their order of arrival, which also serves as the id of the indicator that a first
sighting makes: unique and ascending without a global sort. De-duplication hashes the key on seq only
through an aggregate, so a value that a third of all messages carry is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.functions import columns as C

LONGEST = 2000


def guard(messages: DataFrame) -> DataFrame:
    """Drop values over 2000 characters and whole feed answers (JSON objects with results or data)."""
    v = F.col("value")
    keys = F.json_object_keys(F.when(C.strip(v).rlike(r"^\{"), v))
    answer = F.coalesce(F.array_contains(keys, "results") | F.array_contains(keys, "data"), F.lit(False))
    return messages.filter(v.isNull() | ((F.length(v) <= LONGEST) & ~answer))


def with_defaults(messages: DataFrame) -> DataFrame:
    """source manual and confidence 50 where the key is absent (keys lists those present) or, without keys, null."""
    has = (lambda k: F.array_contains("keys", k)) if "keys" in messages.columns else (lambda k: F.col(k).isNotNull())
    return messages.withColumns({"source": F.when(~has("source"), F.lit("manual")).otherwise(F.col("source")), "confidence": F.when(~has("confidence"), F.lit(50)).otherwise(F.col("confidence"))})


def schema_ok() -> Column:
    ok = F.length("value").between(1, LONGEST) & F.col("type").isNotNull() & F.col("confidence").between(0, 100)
    return F.coalesce(ok, F.lit(False))


def discovered(messages: DataFrame) -> DataFrame:
    """Every message is an event, also one that is rejected later."""
    return messages.select("seq", F.lit("indicator_discovered").alias("event_type"), F.col("value").alias("event_value"), "source")


def raw(messages: DataFrame) -> DataFrame:
    own = F.col("raw_payload") if "raw_payload" in messages.columns else F.to_json(F.struct("value", "type", "source", "confidence"))
    return messages.select("seq", "value", "type", "source", F.coalesce("confidence", F.lit(50)).alias("confidence"), own.alias("raw_payload"))


def judged(messages: DataFrame) -> DataFrame:
    """Messages that meet the schema and can be parsed, with reason (null: accepted) and nvalue."""
    v, t = F.col("value"), F.col("type")
    broken = F.lower(t).isin("url") & C.url_breaks(v)
    return with_defaults(messages).filter(schema_ok()).filter(~F.coalesce(broken, F.lit(False))).withColumns({"reason": C.reason(v, t), "nvalue": C.normal(v, t)})


def rejected(judged_: DataFrame) -> DataFrame:
    return judged_.filter("reason is not null").select("seq", "value", "type", "source", "reason")


def accepted(judged_: DataFrame) -> DataFrame:
    return judged_.filter("reason is null")


def indicators(judged_: DataFrame) -> DataFrame:
    """First-wins de-duplication on (normal value, type as written)."""
    first = F.min_by(F.struct("source", "confidence"), F.col("seq"))
    return accepted(judged_).groupBy(F.col("nvalue").alias("value"), "type").agg(F.min("seq").alias("id"), first.alias("f")).select("id", "value", "type", "f.source", "f.confidence")


def sightings(judged_: DataFrame, known: DataFrame) -> DataFrame:
    """Every accepted message with the id of its indicator."""
    a = accepted(judged_).select("seq", F.col("nvalue").alias("value"), "type", "source", "confidence")
    return a.join(known.select("id", "value", "type"), ["value", "type"]).select("seq", F.col("id").alias("indicator_id"), "source", "confidence")


def only_new(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select("value", "type"), ["value", "type"], "left_anti")


def find_duplicate(stored: DataFrame, value: str, kind: str) -> DataFrame:
    return stored.filter((F.col("value") == value) & (F.col("type") == kind)).limit(1)
