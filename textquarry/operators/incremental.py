"""Work that is done once: changed files, reports, keyed states, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def work_key(columns: list[str], options: str = "", version: str = "") -> Column:
    """A key of what the work depends on: path, size, time, options and the engine's version."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(options), F.lit(version)), 256)


def only_changed(files: DataFrame, done: DataFrame, columns: list[str], options: str = "", version: str = "") -> DataFrame:
    """files whose key is not among those done (key)."""
    return files.withColumn("key", work_key(columns, options, version)).join(done.select("key"), "key", "left_anti")


def latest_per_key(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the larger `tie`."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*")


def reports_if_absent(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """new with status: kept for a key that has a report, else written (the first row of a key; further ones are repeated)."""
    held = existing.select(key).distinct().withColumn("__held", F.lit(True))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key]))
    out = new.withColumn("__turn", turn).join(held, key, "left")
    return out.withColumn("status", F.when(F.col("__held"), "kept").when(F.col("__turn") == 1, "written").otherwise("repeated")).drop("__held", "__turn")


def search_summary(media: DataFrame, pairs: DataFrame, hits: DataFrame, max_new: int = 30) -> DataFrame:
    """One row: total media, cache_hits (reports with a hit), transcribed (new work up to `max_new`), skipped_limit."""
    files = media.select(F.lit("total").alias("counter"), F.lit(None).cast("string").alias("path"))
    new = pairs.where("media_path IS NOT NULL AND report_path IS NULL").select(F.lit("new").alias("counter"), F.col("media_path").alias("path"))
    found = hits.select(F.lit("hit").alias("counter"), F.col("report_path").alias("path"))
    counted = files.union(new).union(found).agg(
        F.count_if(F.col("counter") == "total").alias("total"),
        F.count_distinct(F.when(F.col("counter") == "hit", F.col("path"))).alias("cache_hits"),
        F.count_if(F.col("counter") == "new").alias("new"),
    )
    return counted.select("total", "cache_hits", F.least("new", F.lit(max_new)).alias("transcribed"), F.greatest(F.col("new") - max_new, F.lit(0)).alias("skipped_limit"))
