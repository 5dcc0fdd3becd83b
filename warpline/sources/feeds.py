"""Threat feeds as DataFrames of IOC records: text and JSON parsers, registry, union, a data source.

Every feed gives value, type, source, confidence and pos (its order in the feed). One broken feed never
stops the others: what fails while a plan is made leaves that feed empty, an HTTP feed that fails at run time
answers with a row that has an error and no body, and Registry.run(isolate=True) runs each feed on its
own first, so that any other failure at run time also leaves only that feed empty.
"""

from __future__ import annotations

import functools
import logging
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.client import HTTPException

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from warpline.functions.columns import strip
from warpline.session import checkpointed

LOG = logging.getLogger(__name__)

RECORD = "value string, type string, source string, confidence int, pos long"
THREATFOX = "data array<struct<ioc: string, ioc_type: string>>"
MALWAREBAZAAR = "data array<struct<sha256_hash: string>>"


def _pos() -> Column:
    """Ascends over a body's records, and over bodies as they stand."""
    return F.monotonically_increasing_id().alias("pos")


def lines(text: DataFrame, kind: str, source: str, confidence: int) -> DataFrame:
    """Lines of a column `value` (one or many a row) to records; blank lines go."""
    parts = text.select(F.explode(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line"))
    found = parts.select(strip(F.col("line")).alias("value"), _pos()).filter("value <> ''")
    return found.select("value", F.lit(kind).alias("type"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), "pos")


def openphish(text: DataFrame) -> DataFrame:
    return lines(text, "url", "openphish", 80)


def otx(text: DataFrame) -> DataFrame:
    return lines(text, "domain", "otx", 70)


def threatfox(body: DataFrame) -> DataFrame:
    """JSON text in `value`: data[].ioc with ioc_type, which is domain where the key is missing."""
    d = body.select(F.from_json("value", THREATFOX).alias("j"), F.from_json("value", "data array<map<string, string>>").alias("m"))
    rows = d.select(F.explode(F.arrays_zip(F.col("j.data").alias("d"), F.col("m.data").alias("keys"))).alias("x")).select("x", _pos())
    kind = F.when(F.map_contains_key(F.col("x.keys"), "ioc_type"), F.col("x.d.ioc_type")).otherwise(F.lit("domain"))
    found = rows.select(F.col("x.d.ioc").alias("value"), kind.alias("type"), "pos").filter("value is not null and value <> ''")
    return found.select("value", "type", F.lit("threatfox").alias("source"), F.lit(75).alias("confidence"), "pos")


def malwarebazaar(body: DataFrame) -> DataFrame:
    rows = body.select(F.explode(F.from_json("value", MALWAREBAZAAR)["data"]["sha256_hash"]).alias("value")).select("value", _pos())
    found = rows.filter("value is not null and value <> ''")
    return found.select("value", F.lit("hash").alias("type"), F.lit("malwarebazaar").alias("source"), F.lit(85).alias("confidence"), "pos")


@dataclass
class Feed:
    """A feed: how to fetch its body (a DataFrame with a column value) and how to parse it."""

    name: str
    fetch: Callable[[SparkSession], DataFrame]
    parse: Callable[[DataFrame], DataFrame]

    def collect(self, spark: SparkSession, isolate: bool = False) -> DataFrame:
        try:
            rows = self.parse(self.fetch(spark)).select("value", "type", "source", "confidence", "pos")
            return checkpointed(rows) if isolate else rows
        except Exception as e:  # noqa: BLE001  a feed must not stop the others
            LOG.warning("feed %s failed: %s", self.name, e)
            return spark.createDataFrame([], RECORD)

    def outcome(self, spark: SparkSession) -> tuple[str, int, bool]:
        """(name, number of records, whether the feed could be read), as feed_status() takes it."""
        try:
            body = self.fetch(spark).persist()
            try:
                errors = body.filter("error is not null").count() if "error" in body.columns else 0
                return self.name, self.parse(body).count(), errors == 0
            finally:
                body.unpersist()
        except Exception as e:  # noqa: BLE001
            LOG.warning("feed %s failed: %s", self.name, e)
            return self.name, 0, False


class Registry:
    def __init__(self) -> None:
        self.feeds: list[Feed] = []

    def register(self, feed: Feed) -> None:
        self.feeds.append(feed)

    def run(self, spark: SparkSession, isolate: bool = False) -> DataFrame:
        """UNION ALL of all feeds in the order of registration (feed_ord)."""
        parts = [f.collect(spark, isolate).withColumn("feed_ord", F.lit(i)) for i, f in enumerate(self.feeds)]
        if not parts:
            return spark.createDataFrame([], RECORD + ", feed_ord int")
        return functools.reduce(DataFrame.unionByName, parts)

    def outcomes(self, spark: SparkSession, seq: int = 0) -> DataFrame:
        """name, count, success, seq of a run of every feed: one row a feed."""
        return spark.createDataFrame([(*f.outcome(spark), seq) for f in self.feeds], "name string, count long, success boolean, seq long")


def sample(feeds: DataFrame, n: int = 10) -> DataFrame:
    """The first n records in feed order."""
    return feeds.orderBy("feed_ord", "pos").limit(n)


def answer(feeds: DataFrame, n: int = 10) -> DataFrame:
    """One row: how many records there are, and the first n of them."""
    first = sample(feeds, n).select(F.struct("feed_ord", "pos", "value", "type", "source", "confidence").alias("r"))
    listed = first.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["value"], r["type"], r["source"], r["confidence"])).alias("sample"))
    return feeds.agg(F.count("*").alias("indicators_collected")).crossJoin(listed)  # one row each


class HttpFeed(DataSource):
    """spark.read.format("httpfeed").option("url", ...): one row, with the body as value or what went wrong as error.

    Options: method, body, timeout, headers as header.NAME.
    """

    @classmethod
    def name(cls) -> str:
        return "httpfeed"

    def schema(self) -> str:
        return "value string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str | None, str | None]]:
        headers = {k.partition(".")[2]: v for k, v in self.options.items() if k.startswith("header.")}
        request = urllib.request.Request(self.options["url"], method=self.options.get("method", "GET"), headers=headers, data=self.options.get("body", "").encode() or None)
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "20"))) as r:  # a status of 400 or more raises
                answer = r.read().decode(errors="replace"), None
        except (OSError, HTTPException, ValueError) as e:  # refused, unknown host or scheme, time-out, status, broken answer
            answer = None, f"{type(e).__name__}: {e}"
        yield answer


def http(url: str, timeout: int, **headers: str) -> Callable[[SparkSession], DataFrame]:
    def fetch(spark: SparkSession) -> DataFrame:
        spark.dataSource.register(HttpFeed)
        reader = spark.read.format("httpfeed").option("url", url).option("timeout", timeout)
        for k, v in headers.items():
            reader = reader.option(f"header.{k}", v)
        return reader.load()

    return fetch


def files(path: str) -> Callable[[SparkSession], DataFrame]:
    """Bodies saved as files, one row a file."""
    return lambda spark: spark.read.option("wholetext", True).text(path)
