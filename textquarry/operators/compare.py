"""Comparing N texts: clauses common to all readable documents of a group, and those that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws
from ..sources.shared import written

ENVELOPE = r"(?i)docusign envelope id:\s*((?:[0-9a-f][\s-]*){32})"


#: Abbreviations whose last dot ends no clause.
ABBREVIATIONS = ("S.p.A.", "S.r.l.")
CLAUSE_END = r"(?<=[.;!?])" + "".join(rf"(?<!\Q{a}\E)" for a in ABBREVIATIONS) + r"\s+"
PAGE_NUMBER = r"^\d{1,2}\s+(?=\d+\))"


def clauses(flat: Column) -> Column:
    """Clauses of a text with white space collapsed: cut at a blank behind . ; ! ? that does not close an abbreviation; blanks and dashes at the ends, and a page number before `N)`, go. A dot within a decimal has no blank behind it."""
    shorn = F.transform(F.split(flat, CLAUSE_END), lambda p: collapse_ws(F.regexp_replace(F.trim(p, F.lit(" -")), PAGE_NUMBER, "")))
    return F.filter(shorn, lambda p: p != "")


def envelope_ids(flat: Column) -> Column:
    """Distinct envelope ids of a text, in canonical form, in order of first appearance."""
    digits = F.transform(F.regexp_extract_all(flat, F.lit(ENVELOPE), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"[\s-]", "")))
    shaped = F.transform(digits, lambda d: F.regexp_replace(d, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return F.array_distinct(F.transform(shaped, lambda d: F.concat(F.lit("Docusign Envelope ID: "), d)))


def explode_clauses(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos, clause: envelope ids first, then the clauses of the rest. Unreadable documents have no rows."""
    flat = collapse_ws(F.coalesce(F.col(text_col), F.lit("")))
    body = collapse_ws(F.regexp_replace(flat, ENVELOPE, " "))
    return docs.select(*keys, F.posexplode(F.concat(envelope_ids(flat), clauses(body))).alias("pos", "clause"))


def _hashed(exploded: DataFrame, group: str, doc: str) -> DataFrame:
    """group, doc, a, b, pos: two 64-bit hashes of each distinct clause of a document, and its first place."""
    narrow = exploded.select(group, doc, "pos", F.xxhash64("clause").alias("__a"), F.xxhash64(F.lit("clause"), "clause").alias("__b"))
    return narrow.groupBy(group, doc, "__a", "__b").agg(F.min("pos").alias("pos"))


def _readable(first: DataFrame, group: str, doc: str) -> DataFrame:
    return first.select(group, doc).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("readable")).where("readable >= 2")


def common_clauses(exploded: DataFrame, group: str, doc: str) -> DataFrame:
    """group, clause of clauses in every readable document of a group of at least two; clauses are counted by their hashes, and the text of the common ones alone is fetched."""
    first = _hashed(exploded, group, doc)
    held = first.groupBy(group, "__a", "__b").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct(F.col(doc).alias("doc"), "pos")).alias("at"))
    common = held.join(_readable(first, group, doc), group).where("held = readable").select(group, F.col("at.doc").alias(doc), F.col("at.pos").alias("pos"))
    return exploded.join(common, [group, doc, "pos"], "left_semi").select(group, "clause")


def clause_places(exploded: DataFrame, group: str, doc: str) -> DataFrame:
    """group, doc, pos and hashes of each distinct clause of a document at its first place, written once: texts are cut into clauses once for all that is counted."""
    return written(_hashed(exploded, group, doc), "clause-places")


def difference_places(places: DataFrame, group: str, doc: str, max_parts: int | None = 80) -> DataFrame:
    """group, doc, pos, n, hidden: places of each document's clauses that are not common, in first order, `max_parts` shown (all if it is None) and the rest counted; from hashes and places alone."""
    held = places.groupBy(group, "__a", "__b").agg(F.count(F.lit(1)).alias("held"))
    differs = places.join(held, [group, "__a", "__b"]).join(_readable(places, group, doc), group).where("held < readable")
    own = Window.partitionBy(group, doc)
    over = F.lit(0).cast("long") if max_parts is None else F.greatest(F.count(F.lit(1)).over(own) - max_parts, F.lit(0))
    ranked = differs.select(group, doc, "pos", F.row_number().over(own.orderBy("pos")).alias("n"), over.alias("hidden"))
    return ranked if max_parts is None else ranked.where(F.col("n") <= max_parts)


def text_differences(exploded: DataFrame, group: str, doc: str, max_parts: int | None = 80) -> DataFrame:
    """group, doc, n, clause, hidden: each document's clauses that are not common, distinct, in first order, `max_parts` shown (all if it is None) and the rest counted.

    Group sizes, common and differing clauses and ranks follow from hashes of
    clauses and their places; the text of the clauses that are shown is fetched
    by its place.
    """
    shown = difference_places(clause_places(exploded, group, doc), group, doc, max_parts)
    return exploded.join(shown, [group, doc, "pos"]).select(group, doc, "n", "clause", "hidden")


def fact_differences(facts: DataFrame, group: str, doc: str, fact_cols: dict[str, str], optional: str | None = None, absent: str = "non disponibile") -> DataFrame:
    """group, doc, fact, value of facts whose values differ within the group. fact_cols: column to name; `optional` counts only where some document has it, and is `absent` elsewhere."""
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c, name in fact_cols.items()])
    long = facts.select(group, doc, F.explode(pairs).alias("f")).select(group, doc, "f.fact", "f.value")
    each = Window.partitionBy(group, "fact")
    if optional:
        any_has = F.max(F.when(F.col("value") != "", 1).otherwise(0)).over(each) == 1
        long = long.withColumn("any", any_has).where((F.col("fact") != optional) | F.col("any")).drop("any")
        long = long.withColumn("value", F.when((F.col("fact") == optional) & (F.col("value") == ""), absent).otherwise(F.col("value")))
    long = long.withColumn("lo", F.min("value").over(each)).withColumn("hi", F.max("value").over(each))
    return long.where("lo <> hi AND value <> ''").drop("lo", "hi")


def comparison_summary(docs: DataFrame, differences: DataFrame, exploded: DataFrame, group: str, doc: str, facts: DataFrame | None = None) -> DataFrame:
    """group, n_files, differing (unreadable ones count), hidden, coincide. `differences` and `exploded` may be places without texts."""
    readable = exploded.select(group, doc).distinct().withColumn("readable", F.lit(True))
    shown = differences.groupBy(group, doc).agg(F.max("hidden").alias("hidden")).withColumn("differs", F.lit(True))
    out = docs.select(group, doc).join(readable, [group, doc], "left").join(shown, [group, doc], "left")
    if facts is not None:
        out = out.join(facts.select(group, doc).distinct().withColumn("facts", F.lit(True)), [group, doc], "left")
    else:
        out = out.withColumn("facts", F.lit(None).cast("boolean"))
    differs = F.col("readable").isNull() | F.coalesce("differs", F.lit(False)) | F.coalesce("facts", F.lit(False))
    summed = out.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(differs).alias("differing"), F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden"))
    return summed.withColumn("coincide", F.col("differing") == 0)
