"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@functools.cache
def _own_folder(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, for files that are written and read back. Where that is unset, a local one if all runs in one process; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within send Python workers at most BATCH bytes at once (a row at least)."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one, so that no batch stands in Python objects as a whole."""
    for batch in parts:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def batches(rows: Iterator[tuple], schema: pa.Schema, at: int = -1, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` bytes, by the length of the field `at`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at]) + 200
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: worked out once, however often it is used."""
    path = shared_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
