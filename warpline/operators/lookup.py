"""Analyst look-ups: each takes a table and answers with a DataFrame; filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = ("id", "value", "type", "source", "confidence", "created_at")


def indicator_list(indicators: DataFrame) -> DataFrame:
    return indicators.select(*[c for c in RESPONSE if c in indicators.columns])


def indicator(indicators: DataFrame, id_: int) -> DataFrame:
    """One row, or none (which an API would answer with 404)."""
    return indicator_list(indicators.filter(F.col("id") == id_)).limit(1)


def pivot_domain(indicators: DataFrame, domain: str) -> DataFrame:
    """Values that contain the text; % and _ in it are wildcards, as LIKE has them."""
    return indicators.filter(F.col("value").like(f"%{domain}%"))


def pivot_ip(indicators: DataFrame, ip: str) -> DataFrame:
    return indicators.filter(F.col("value") == ip)


def campaign_list(campaigns: DataFrame) -> DataFrame:
    return campaigns


def campaign(campaigns: DataFrame, campaign_id: str) -> DataFrame:
    return campaigns.filter(F.col("campaign_id") == campaign_id).limit(1)


def timeline(events: DataFrame, campaign_id: str) -> DataFrame:
    return events.filter(F.col("campaign_id") == campaign_id).orderBy("created_at", "id")


def feed_by_name(feeds: DataFrame, name: str) -> DataFrame:
    return feeds.filter(F.col("name") == name).limit(1)


def related(edges: DataFrame, value: str) -> DataFrame:
    """Extension: what a value is linked with."""
    out = edges.filter(F.col("src_value") == value).select("rel", F.col("dst_label").alias("label"), F.col("dst_value").alias("value"))
    return out.unionByName(edges.filter(F.col("dst_value") == value).select("rel", F.col("src_label").alias("label"), F.col("src_value").alias("value"))).distinct()


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS ok")


def envelope(rows: DataFrame) -> DataFrame:
    """Extension: rows as one JSON text each inside a status and data answer."""
    return rows.select(F.lit("success").alias("status"), F.to_json(F.struct("*")).alias("data"), F.lit(None).cast("string").alias("error"))
