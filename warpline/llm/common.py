"""Helpers that the corpus operators share: the shared folder, materialised tables, text buffers."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.session import shared_folder

#: what stands for a null doc_id in keys, before all others or after them
NO_ID, LAST_ID = -(2**63), 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can read and write."""
    return shared_folder(spark)


def materialise(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/warpline-" in d:
                path = jvm.org.apache.hadoop.fs.Path(d)
                path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing holds any more; it does so after collections.

    The first collection frees what Python held, the second what that held in turn.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession, per: int = 1) -> int:
    """Shuffle partitions for steps that need an explicit number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per


def spare(docs: DataFrame) -> str:
    """A prefix that makes any name one that no column of docs has."""
    return "_" * (1 + max([0, *map(len, docs.columns)]))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch to a Python worker holds, as single texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text counts as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, n + 1 offsets) of an Arrow string column, without copying texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def table(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
