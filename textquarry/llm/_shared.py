"""Folders that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
BROADCAST = 16 << 20  # bytes of a table that all executors may get


@functools.cache
def _own_dir(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. Where it is unset, a new local one if all runs in one process; on a cluster that would not be shared, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within send Python workers at most BATCH bytes at once (a row at least), as well as the session's number of rows."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage ends, sizes are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame) -> DataFrame:
    """`df` (of numbers) with a broadcast hint if it takes at most BROADCAST bytes, else as it is. `df` should be cheap to count."""
    most = BROADCAST // (24 + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def exchange_width(spark: SparkSession, size: int, per_task: int) -> int:
    """Partitions for an exchange: the session's number, more if `size` needs more of `per_task` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))
