"""Ranks and running sums over large groups, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

CELL = 10_000  # values of the order that a cell spans


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, cell: int = CELL) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same keys that come before, by `order` (ties in any order).

    Rows of a group are summed within cells, each a stretch of the order; cells
    of a group are prefix-summed as a small table. So a group of any size is
    spread over tasks, and none ranks more than a cell's rows or a group's cells.
    Null orders are one cell, the first. An order that is no whole number has no
    stretches: then a group is one cell. All columns of `df` go through a window
    and a join, so callers pass narrow rows and join texts back by their id.
    """
    whole = isinstance(df.schema[order].dataType, IntegralType)
    at = F.lit(0).cast("long") if not whole else F.coalesce(F.floor(F.col(order) / cell).cast("long"), F.lit(-(2**62)))
    split = df.withColumn("__cell", at).withColumn("__value", value)
    names = [F.coalesce(F.col(k).cast("string"), F.lit("\x01")).alias(f"__key{i}") for i, k in enumerate(keys)]
    split = split.select("*", *names)
    own = [f"__key{i}" for i in range(len(keys))]
    cells = split.groupBy(*own, "__cell").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*own).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*own, "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*own, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = split.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0))).join(cells, [*own, "__cell"])
    return out.withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).select(*[c for c in df.columns if c != name], name)
