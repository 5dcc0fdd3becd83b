"""Recurring jobs over the stored tables: enrichment, graph, campaigns. Each is a set-oriented append.

A job reads what is stored, computes the rows that are missing by anti-joins, and appends them, so a
second run adds nothing. every() repeats a job in a Structured Streaming loop.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warpline import schemas
from warpline.operators import campaigns, cluster, enrich, lifecycle, lookup
from warpline.session import children, delete, scratch
from warpline.streaming.graph_store import GraphStore

LOG = logging.getLogger(__name__)


@dataclass
class Store:
    """Parquet tables under one folder; a table is empty before its first append."""

    spark: SparkSession
    base: str

    def read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def append(self, rows: DataFrame, name: str, schema: str) -> None:
        """Append rows in the declared schema; created_at and the like are stamped, missing columns are null."""
        want = self.spark.createDataFrame([], schema).schema
        stamp = {"created_at", "first_seen", "started_at"}
        value = lambda f: F.col(f.name) if f.name in rows.columns else F.current_timestamp() if f.name in stamp else F.lit(None)
        rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in want]).write.mode("append").parquet(f"{self.base}/{name}")

    def last(self, rows: DataFrame, name: str) -> DataFrame:
        """What a run of a job found, as a table of its own; it goes with the second run after."""
        runs = self.numbers(f"_last/{name}")
        path = f"{self.base}/_last/{name}/run={max([0, *runs]) + 1}"
        rows.write.parquet(path)
        for n in runs[:-1]:
            delete(self.spark, f"{self.base}/_last/{name}/run={n}")
        return self.spark.read.schema(rows.schema).parquet(path)

    def replace(self, rows: DataFrame, name: str) -> None:
        """Rewrite a small table by way of a copy, as it may be read from itself."""
        self.last(rows, name).write.mode("overwrite").parquet(f"{self.base}/{name}")

    def numbers(self, name: str) -> list[int]:
        """The numbers of a table's runs."""
        return sorted(int(c[4:]) for c in children(self.spark, f"{self.base}/{name}") if c.startswith("run="))


def enrich_pending(store: Store, indicators: DataFrame, ref_asn: DataFrame, ref_dns: DataFrame, ref_whois: DataFrame) -> DataFrame:
    """Enrich indicators without a row, append rows and events; returns the new rows.

    If the look-ups or the append fail, the failure is logged, nothing is stored and no event is made;
    the indicators stay pending for the next run.
    """
    todo = enrich.pending(indicators, store.read("enrichment", schemas.ENRICHMENT))
    wanted = enrich.enrich(todo, ref_asn, ref_dns, ref_whois)
    try:
        new = store.last(wanted, "enrichment")
        store.append(new, "enrichment", schemas.ENRICHMENT)  # a Parquet write adds all its files or none
    except Exception:  # noqa: BLE001
        LOG.exception("enrichment failed")
        return store.spark.createDataFrame([], wanted.schema)
    store.append(enrich.events(new, indicators), "timeline", schemas.TIMELINE)
    return new


def build_graph(store: Store, indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all indicators with their first enrichment. Only indicators that are new, or newly enriched, change the stored graph.

    What a run takes in is written down before it changes anything, so a run that was stopped is finished first, as it was planned.
    """
    spark, graph = store.spark, GraphStore(store.spark, f"{store.base}/graph")
    stored = store.read("enrichment", schemas.ENRICHMENT)
    first = campaigns.latest(stored.withColumn("_age", -F.unix_micros("created_at")), "indicator_id", "_age").drop("_age")
    ind = indicators.select("id", "value", "type", "source", "confidence")
    plan = "id long, enriched boolean, before boolean, run int"

    def take(run: int) -> None:
        todo = spark.read.schema(plan).option("basePath", f"{store.base}/graph_plan").parquet(f"{store.base}/graph_plan/run={run}")
        of = lambda where: todo.filter(where).select("id")
        rows = lambda where: first.join(of(where).withColumnRenamed("id", "indicator_id"), "indicator_id", "left_semi")
        graph.apply(run, (ind.join(of("true"), "id", "left_semi"), rows("enriched")), (ind.join(of("before"), "id", "left_semi"), rows("false")))
        spark.createDataFrame([(run,)], "done int").write.mode("overwrite").parquet(f"{store.base}/graph_done/run={run}")

    planned, done = store.numbers("graph_plan"), store.numbers("graph_done")
    for run in [n for n in planned if n not in set(done)]:
        take(run)
    was = store.read("graph_plan", plan).groupBy("id").agg(F.max("enriched").alias("was"))
    now = ind.select("id").join(first.select(F.col("indicator_id").alias("id"), F.lit(True).alias("has")), "id", "left").join(was, "id", "left")
    fresh = now.filter(F.col("was").isNull() | (~F.col("was") & F.col("has"))).select("id", F.coalesce("has", F.lit(False)).alias("enriched"), F.col("was").isNotNull().alias("before"))
    run = max([0, *planned]) + 1
    fresh = store.last(fresh, "graph_plan")
    if not fresh.isEmpty():
        fresh.write.mode("overwrite").parquet(f"{store.base}/graph_plan/run={run}")
        take(run)
    return graph.nodes(), graph.edges()


def run_campaigns(store: Store, indicators: DataFrame) -> DataFrame:
    """Detect campaigns, store the new ones with an event each; returns all that were detected.

    Only values that came since the last run are clustered. Where an earlier value has another fingerprint by now, or was enriched late, the clusters
    are made anew.
    """
    values = cluster.by_value(store.read("enrichment", schemas.ENRICHMENT), indicators)
    grown = cluster.Leaders(store.spark, f"{store.base}/leaders")
    run = grown.last_run() + 1
    try:
        grown.append(values, run)
    except ValueError as e:
        LOG.info("clusters are made anew: %s", e)
        grown.rebuild(values, run)
    found = store.last(campaigns.identified(cluster.as_arrays(grown.members())), "found")
    new = store.last(campaigns.new_rows(found, store.read("campaigns", schemas.CAMPAIGNS)), "new_campaigns")
    store.append(new, "campaigns", schemas.CAMPAIGNS)
    store.append(campaigns.created_events(new), "timeline", schemas.TIMELINE)
    return found


def track_campaigns(store: Store, found: DataFrame) -> DataFrame:
    """Extension: compare what was detected with the memberships of the last run, store both sides' changes; returns the memberships under lasting ids."""
    runs = store.numbers("memberships")
    path = lambda run: f"{store.base}/memberships/run={run}"
    read = lambda run: store.spark.read.schema(schemas.MEMBERSHIPS).parquet(path(run))
    run = max([0, *runs]) + 1
    with scratch(store.spark):
        old = read(max(runs)) if runs else store.spark.createDataFrame([], schemas.MEMBERSHIPS)
        now, events = lifecycle.step(old, found)
        store.append(events.filter("event_type <> 'campaign_created'"), "timeline", schemas.TIMELINE)  # run_campaigns tells of new ones
        now.write.mode("overwrite").parquet(path(run))
    for n in runs[:-1]:
        delete(store.spark, path(n))
    return read(run)


def materialise_scores(store: Store, found: DataFrame) -> DataFrame:
    """Scored campaigns appended to their own table."""
    rows = store.last(campaigns.materialised(campaigns.scored(found)), "scores")
    store.append(rows, "scored_campaigns", schemas.CAMPAIGNS)
    return rows


def update_feeds(store: Store, runs: DataFrame) -> DataFrame:
    """Upsert of feed runs (name, count, success, seq); last_run stays as it was first set."""
    old = store.read("feeds", schemas.FEEDS)
    new = campaigns.feed_status(runs, old).join(old.select("name", "last_run", "last_success"), "name", "left")
    rows = new.select("name", F.coalesce("last_run", F.current_timestamp().cast("timestamp_ntz")).alias("last_run"), "last_success", F.col("indicators_collected").cast("int").alias("indicators_collected"), "status")
    store.replace(rows, "feeds")
    return store.read("feeds", schemas.FEEDS)


def timeline(store: Store, campaign_id: str) -> DataFrame:
    return lookup.timeline(store.read("timeline", schemas.TIMELINE), campaign_id)


def every(spark: SparkSession, seconds: int, job: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Run a job each so many seconds until the query is stopped; a failing run is logged and the next trigger runs it again."""

    def tick(_: DataFrame, __: int) -> None:
        try:
            job()
        except Exception:  # noqa: BLE001
            LOG.exception("a recurring job failed")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").start()
