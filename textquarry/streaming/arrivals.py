"""Streams: search in what arrives, standing searches, latest rows.

Search over arrivals is stateless, so it needs no watermark: files that the
source has seen are in its checkpoint and are read once. The latest row of a
key is keyed state that Spark keeps in its state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import contains_all
from ..operators.search import first_line_hit, match_profiles, run_profiles


def arrivals(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Rows of files as they come."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def search_arrivals(docs: DataFrame, terms: list[str], keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, line_number, snippet: the first line of each arriving document that holds every term, with two lines around it."""
    held = docs.where(contains_all(F.col(text_col), terms))
    return held.select(*keys, F.inline(first_line_hit(F.col(text_col), terms)))


def standing_search(docs: DataFrame, profiles: DataFrame, keys: list[str], text_col: str = "text", most: int = 1000) -> DataFrame:
    """name, keys of every saved profile (name, terms) that an arriving document matches; profiles stand in blocks of at most `most`, held by every task."""
    return match_profiles(docs, profiles, text_col, most).select("name", *keys)


def standing_to_table(docs: DataFrame, profiles: Callable[[SparkSession], DataFrame], keys: list[str], path: str, checkpoint: str, text_col: str = "text", path_col: str | None = None) -> StreamingQuery:
    """Every batch is searched by the profiles as `profiles` reads them when it begins, so that one that is added or withdrawn counts from the next batch on; name, keys, and the profiles' version if they have that column, go to the folder `path`/batch=N. A batch that is repeated replaces its own. For profiles see `run_profiles`."""

    def put(batch: DataFrame, number: int) -> None:
        now = profiles(batch.sparkSession)
        found = run_profiles(batch.persist(StorageLevel.MEMORY_AND_DISK), now, text_col, path_col)
        found.select("name", *keys, *[c for c in ("version",) if c in now.columns]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_stream(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key so far, for update or complete output."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(key, "r.*")


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to files until the source has no more, exactly once with the same checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch writes the keys that it changed, as a folder `path`/batch=N, N the batch; a batch that is repeated replaces its own. `latest_table` reads the state."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of the latest batch of each key below `path`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


# ------------------------------------------------------------ a log of latest rows
#
# path/level=L/to=N holds the newest row of each key among some batches up to N.
# Batch N is level 0. With every FAN-th batch the last FAN folders of level 0 merge
# into one of level 1, with every FAN*FAN-th those of level 1 into one of level 2,
# and so on, so that a reader meets at most FAN - 1 folders of each level. What is
# merged follows from N alone: a batch that is repeated writes the same again.

FAN = 8


def _merges(number: int, fan: int) -> list[tuple[int, list[int]]]:
    """The levels that batch `number` completes, each with the last batches of the folders below that it takes."""
    out, width = [], 1
    while (number + 1) % (width * fan) == 0:
        out.append((len(out) + 1, [number - k * width for k in range(fan)]))
        width *= fan
    return out


def _cover(number: int, fan: int) -> list[tuple[int, int]]:
    """level, last batch of the folders that together hold batches 0 to `number`."""
    out, done, rest = [], 0, number + 1
    level = 0
    while fan ** (level + 1) <= rest:
        level += 1
    for k in range(level, -1, -1):
        while rest >= fan**k:
            done, rest = done + fan**k, rest - fan**k
            out.append((k, done - 1))
    return out


def _newest(rows: DataFrame, key: str, time: str, tie: str, idle: int | None) -> DataFrame:
    """The newest row of each key; with `idle`, without keys whose row is more than so many seconds older than the newest of all."""
    latest = latest_stream(rows, key, time, tie)
    if idle is None:
        return latest
    end = rows.agg(F.max(time).alias("__end"))
    return latest.join(F.broadcast(end), F.col(time) >= F.timestamp_add("SECOND", F.lit(-idle), "__end")).drop("__end")


def latest_to_log(rows: DataFrame, key: str, time: str, tie: str, path: str, checkpoint: str, idle: int | None = None, fan: int = FAN) -> StreamingQuery:
    """Newest rows of keys as a log of folders, without any state in the stream: a batch writes its own newest rows, and merges of earlier folders that it completes; folders that merges took go one merge later, when no reader that began before it needs them. Merges drop keys that were idle for more than `idle` seconds of the rows' time."""
    schema = rows.schema

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest_stream(batch, key, time, tie).select(*schema.names).write.mode("overwrite").parquet(f"{path}/level=0/to={number}")
        for level, parts in _merges(number, fan):
            held = spark.read.schema(schema).parquet(*[f"{path}/level={level - 1}/to={n}" for n in parts])
            _newest(held, key, time, tie, idle).select(*schema.names).write.mode("overwrite").parquet(f"{path}/level={level}/to={number}")
            width = fan ** (level - 1)
            for n in [number - fan * width - k * width for k in range(fan)]:  # what the merge before this one took
                _drop(spark, f"{path}/level={level - 1}/to={n}")
        spark.createDataFrame([(number, fan)], "number long, fan int").coalesce(1).write.mode("overwrite").json(f"{path}/last={number % 2}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def log_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of a log that a reader needs now."""
    number, fan = max((r["number"], r["fan"]) for r in spark.read.schema("number long, fan int").json(f"{path}/last=*").collect())
    return [f"{path}/level={level}/to={n}" for level, n in _cover(number, fan)]


def latest_log(spark: SparkSession, path: str, schema: StructType, key: str, time: str, tie: str, idle: int | None = None) -> DataFrame:
    """The newest row of each key of a log that `latest_to_log` writes."""
    return _newest(spark.read.schema(schema).parquet(*log_folders(spark, path)), key, time, tie, idle).select(*schema.names)
