"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / source size` times. The
expected copies are prefix-summed in one order of the source's documents, a
random offset of the source is added, and a document is emitted once for each
integer that its stretch of the sum crosses. Texts are read once for their
sizes; all else works on narrow rows, and the mix reads texts once more to take
them.

The order is by size class, then salt, then size and id. A class of n documents
has about sqrt(n) salts, so that a hot source, or one size that fills it, is
ranked in cells of about sqrt(n) rows; offsets of cells come from a small table
of counts. Going by size keeps the words taken near the target: the sum drifts
from it by less than one document at every point of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut

WORDS = r"[^\x20\x09-\x0D]+"
CLASSES_PER_OCTAVE = 8
NAMES = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(classes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Per source (`source`, null as it is) of a table of sizes (source, n, mix_size): n, source_size, target.

    Sources in code point order (null last) weigh `weights`, repeating. Targets
    share the total size by weight; one above `most` times its source's size
    stops there and the excess goes to the others by weight, until none is above.
    That is min(most * size, level * weight) with one level for all: sources
    reach their stop in the order of size / weight, so running sums in that
    order give the level.
    """
    sources = classes.groupBy("source").agg(F.sum("n").alias("n"), F.sum("mix_size").alias("source_size"))
    everything = Window.partitionBy()
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    stop = F.col("source_size") * F.lit(float(most))
    before = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
        .withColumn("ratio", stop / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(stop).over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))
        # the first source, in the order of ratio, that the level does not bring to its stop
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .select("source", "n", "source_size", F.least(stop, F.coalesce(F.col("level") * F.col("weight"), stop)).alias("target"))
    )


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """The one pass over texts: doc_id, source, mix_size, and two hashes that name a row by all three."""
    own = ["doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text"]
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size"), F.xxhash64(F.lit(seed), *own).alias("__mix_a"), F.xxhash64(F.lit(seed + 1), *own).alias("__mix_b"))
    size_class = F.floor(F.log2(F.col("mix_size") + F.lit(1.0)) * CLASSES_PER_OCTAVE).cast("int")
    return cut(narrow.select("*", F.col("source").isNull().alias("__mix_null"), F.coalesce("source", F.lit("")).alias("__mix_source"), size_class.alias("__mix_class")), "mix-rows")


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    narrow = _rows(docs, seed)
    where = ["__mix_null", "__mix_source"]
    classes = narrow.groupBy(*where, "__mix_class").agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("mix_size"))
    classes = cut(classes.withColumn("__mix_salts", F.ceil(F.sqrt("n"))), "mix-classes")
    targets = source_targets(classes.select(F.when(~F.col("__mix_null"), F.col("__mix_source")).alias("source"), "n", "mix_size"), weights, most)
    salted = narrow.join(broadcast_if(classes.select(*where, "__mix_class", "__mix_salts")), [*where, "__mix_class"])
    salted = salted.withColumn("__mix_salt", F.pmod("__mix_a", "__mix_salts"))
    cell = [*where, "__mix_class", "__mix_salt"]
    cells = salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("__mix_n"))
    # rows before a cell: those of earlier classes of its source, then those of earlier salts of its class
    earlier = Window.partitionBy(*where).orderBy("__mix_class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = classes.select(*where, "__mix_class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__mix_before"))
    in_class = Window.partitionBy(*where, "__mix_class").orderBy("__mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__mix_row0", F.coalesce(F.sum("__mix_n").over(in_class), F.lit(0))).drop("__mix_n")
    cells = cells.join(by_class, [*where, "__mix_class"]).withColumn("__mix_row0", F.col("__mix_row0") + F.col("__mix_before")).drop("__mix_before")
    plan = cells.join(targets.select(F.col("source").isNull().alias("__mix_null"), F.coalesce("source", F.lit("")).alias("__mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), where)
    plan = cut(plan, "mix-cells")

    in_cell = Window.partitionBy(*cell).orderBy("mix_size", F.col("doc_id").asc_nulls_first(), "__mix_a", "__mix_b")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "__mix_null", "__mix_source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = F.col("__mix_row0") + F.row_number().over(in_cell)
    return (
        salted.join(broadcast_if(plan), cell)
        .withColumn("__mix_last", last)
        .withColumn("mix_copies", (F.floor(offset + F.col("__mix_last") * rate) - F.floor(offset + (F.col("__mix_last") - 1) * rate)).cast("long"))
        .select("doc_id", "source", *NAMES, "__mix_a", "__mix_b")
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Per row of `docs`: doc_id, source, mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    Null text has size 0, null source is a source of its own, null ids rank
    first in their cell, ties go by a hash of the text; rows that repeat get
    their own copies each; an empty table gives an empty one. A source of size 0
    has target 0 and no copies. Other columns are ignored.
    """
    return _mixed(docs, weights, most, seed).drop("__mix_a", "__mix_b")


def emit_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: rows of `docs` with more than 0 copies, each as often as it has copies, columns as in `docs`.

    Nulls, ties and empty tables are as in `mix_sources`. Rows alike in doc_id,
    source and text share their copies evenly, whatever their other columns
    hold. Columns of `docs` that start with `__mix` are left out.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("__mix")])
    names = ["__mix_a", "__mix_b"]
    taken = _mixed(docs, weights, most, seed).groupBy(*names).agg(F.sum("mix_copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_twins")).where("__mix_copies > 0")
    own = ["doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text"]
    named = docs.select("*", F.xxhash64(F.lit(seed), *own).alias("__mix_a"), F.xxhash64(F.lit(seed + 1), *own).alias("__mix_b"))
    held = named.join(broadcast_if(cut(taken, "mix-taken")), names)
    one = held.where("__mix_twins = 1")
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(*names)) - 1
    more = held.where("__mix_twins > 1").withColumn("__mix_turn", turn)
    share = F.expr("__mix_copies div __mix_twins") + F.when(F.col("__mix_turn") < F.col("__mix_copies") % F.col("__mix_twins"), 1).otherwise(0)
    more = more.withColumn("__mix_copies", share).drop("__mix_turn").where("__mix_copies > 0")
    return one.unionByName(more).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
