"""Counts of events in windows of event time, kept by a stream with a watermark. Optional in the survey.

Late events count as long as the watermark has not passed the end of their window; then the window is written, once, and its state goes. Events
that come later still are dropped, as the watermark says. So the state holds the open windows only, whatever the stream's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warpline.session import exists

COUNTS = "window_start timestamp_ntz, window_end timestamp_ntz, kind string, n long, first_at timestamp_ntz, last_at timestamp_ntz"


def counted(events: DataFrame, width: str) -> DataFrame:
    """window_start, window_end, kind, n, first_at, last_at of events (at, kind), batch or stream."""
    rows = events.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return rows.select(plain("w.start").alias("window_start"), plain("w.end").alias("window_end"), "kind", "n", plain("first_at").alias("first_at"), plain("last_at").alias("last_at"))


def start(events: DataFrame, base: str, *, width: str = "1 hour", late: str = "2 hours", once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Write the counts of a stream of events (at, kind) to base/counts, each window when it is closed."""
    closed = counted(events.withWatermark("at", late), width)
    writer = closed.writeStream.outputMode("append").option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/counts").format("parquet")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def table(spark: SparkSession, base: str) -> DataFrame:
    """The closed windows."""
    return spark.read.schema(COUNTS).parquet(f"{base}/counts") if exists(spark, f"{base}/counts") else spark.createDataFrame([], COUNTS)
