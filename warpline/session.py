"""SparkSession with the settings the engine expects."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def session(master: str | None = None, name: str = "warpline") -> SparkSession:
    """UTC, adaptive execution with skew handling; sizes of shuffles are left to the cluster."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where none is named, a session on one machine (master local) gets a temporary one; a cluster is refused.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="warpline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below checkpoint_folder()."""
    return f"{checkpoint_folder(spark)}/warpline-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Hadoop's file systems find it; one that isn't there does no harm."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Inside, checkpointed() writes to one folder, which goes at the end: for jobs that store what they return."""
    path = shared_folder(spark)
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        delete(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that all executors share: a table of the open scratch folder, or a checkpoint."""
    spark, base = df.sparkSession, _SCRATCH.get()
    if base is None:
        checkpoint_folder(spark)
        return df.checkpoint()
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_table(spark: SparkSession) -> str:
    """A new folder for a table that grows by appends: in the open scratch folder, or below checkpoint_folder()."""
    base = _SCRATCH.get()
    return f"{base}/{uuid.uuid4().hex}" if base else shared_folder(spark)
