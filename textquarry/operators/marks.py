"""Marks in texts and media: places that survive edits of the text, kept in tables.

A mark: doc_key, id, pos (0-based), anchor, prefix, saved, excerpt, is_resume.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws

HITS, CLOSE, PER_DOC, DOCS, EXCERPT = 12, 15, 100, 200, 90


def place_of(text: Column, pos: Column, anchor: Column, prefix: Column, most_hits: int = HITS) -> Column:
    """Struct place, outcome: exact, found (of the first `most_hits` occurrences: that behind the prefix, else the nearest), nearest (the old place) or empty."""
    step = lambda acc, _: F.when(F.element_at(acc, -1) == 0, acc).otherwise(F.concat(acc, F.array(F.call_function("locate", anchor, text, F.element_at(acc, -1) + 1))))
    first = F.array(F.call_function("locate", anchor, text, F.lit(1)))
    hits = F.filter(F.aggregate(F.sequence(F.lit(2), F.lit(most_hits)), first, step), lambda x: x > 0)
    hits = F.transform(hits, lambda x: (x - 1).cast("int"))
    behind = F.filter(hits, lambda h: F.substring(text, F.greatest(h - F.char_length(prefix), F.lit(0)) + 1, F.least(h, F.char_length(prefix))) == prefix)
    nearest = F.array_min(F.transform(hits, lambda h: F.struct(F.abs(h - pos).alias("d"), h.alias("h"))))["h"]
    clamped = F.greatest(F.lit(0), F.least(pos, F.char_length(text)))
    here = (pos >= 0) & (pos <= F.char_length(text)) & (F.substring(text, pos + 1, F.char_length(anchor)) == anchor)
    found = F.when((prefix != "") & (F.size(behind) > 0), F.get(behind, F.lit(0))).otherwise(nearest)
    return (
        F.when(text == "", F.struct(F.lit(0).alias("place"), F.lit("empty").alias("outcome")))
        .when(anchor == "", F.struct(clamped.alias("place"), F.lit("exact").alias("outcome")))
        .when(here, F.struct(pos.alias("place"), F.lit("exact").alias("outcome")))
        .when(F.size(hits) > 0, F.struct(found.alias("place"), F.lit("found").alias("outcome")))
        .otherwise(F.struct(clamped.alias("place"), F.lit("nearest").alias("outcome")))
    )


def resolve_marks(marks: DataFrame, docs: DataFrame, doc: str = "doc_key", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """marks with place and outcome in the texts as they are now, and these as `keep` if it is named; a text that is gone counts as empty."""
    joined = marks.join(docs.select(doc, F.col(text_col).alias("__text")), doc, "left")
    none = F.lit("")
    at = place_of(F.coalesce("__text", none), F.coalesce("pos", F.lit(0)).cast("int"), F.coalesce("anchor", none), F.coalesce("prefix", none))
    return joined.withColumn("__at", at).select(*marks.columns, "__at.place", "__at.outcome", *([F.col("__text").alias(keep)] if keep else []))


def excerpt_at(text: Column, pos: Column, limit: int = EXCERPT) -> Column:
    """The line at a place, from a blank line the text behind it; collapsed, at most `limit` with an ellipsis."""
    at = F.greatest(F.lit(0), F.least(pos, F.char_length(text)))
    before = F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)
    after = F.substring_index(F.substring(text, at + 1, F.char_length(text)), "\n", 1)
    line = F.concat(before, after)
    line = F.when((collapse_ws(line) == "") & (at < F.char_length(text)), F.substring(text, at + 1, F.lit(limit))).otherwise(line)
    flat = collapse_ws(line)
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def add_marks(marks: DataFrame, new: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_key, id, pos, anchor, prefix, saved, excerpt, is_resume, status of all marks after new ones (doc_key, pos, saved) in order of saved.

    A new mark at an old one's spot (equal excerpt, or within 15 characters of
    where it now is) is `already` and moves the resume point there; a full
    document takes none (`full`, not kept); else it is `added`. One document's
    marks are at most 100, so each is taken in turn in one group.
    """
    text = docs.select("doc_key", "text")
    placed = resolve_marks(marks, docs, keep="text").withColumn("now", F.when(F.col("outcome") == "empty", "").otherwise(excerpt_at(F.coalesce("text", F.lit("")), F.col("place"))))
    placed = placed.withColumn("status", F.lit("old")).drop("outcome", "text")
    fresh = new.join(text, "doc_key")
    fresh = fresh.select(
        "doc_key", F.lit(None).cast("string").alias("id"), F.col("pos").cast("int").alias("pos"), F.substring("text", F.col("pos") + 1, F.lit(80)).alias("anchor"),
        F.substring("text", F.greatest(F.col("pos") - 40, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(40))).alias("prefix"), "saved", excerpt_at(F.col("text"), F.col("pos")).alias("excerpt"), excerpt_at(F.col("text"), F.col("pos")).alias("now"),
        F.lit(False).alias("is_resume"), F.col("pos").cast("int").alias("place"), F.lit("new").alias("status"),
    )
    fields = ["doc_key", "id", "pos", "anchor", "prefix", "saved", "excerpt", "is_resume", "place", "status", "now"]

    def take(every: list[dict]) -> list[dict]:
        rows = [m for m in every if m["status"] == "old"]
        out = []
        close = lambda r, m: r["place"] is not None and m["pos"] is not None and abs(r["place"] - m["pos"]) <= CLOSE
        for m in sorted((m for m in every if m["status"] == "new"), key=lambda m: (m["saved"] is None, m["saved"] or 0)):
            spot = next((r for r in rows if r["now"] and r["now"] == m["now"] or close(r, m)), None)
            if spot is None and len(rows) >= PER_DOC:
                out.append(m | {"status": "full"})
                continue
            if spot is None:
                numbers = [int(r["id"]) for r in rows if str(r["id"]).isdigit()]
                spot = m | {"id": str(max(numbers, default=0) + 1), "status": "added"}
                rows.append(spot)
            elif spot["status"] == "old":
                spot["status"] = "already"
            for r in rows:
                r["is_resume"] = r is spot
        return rows + out

    own = fields[1:-1]
    kinds = dict(id=pa.string(), pos=pa.int32(), anchor=pa.string(), prefix=pa.string(), saved=pa.int64(), excerpt=pa.string(), is_resume=pa.bool_(), place=pa.int32(), status=pa.string())
    schema = pa.schema({"doc_key": pa.string()} | {c: kinds[c] for c in own})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [{"doc_key": key} | m for key, every in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in take(every)]
                yield pa.RecordBatch.from_pylist([{c: m[c] for c in schema.names} for m in rows], schema=schema)

    every = placed.select(*fields).unionByName(fresh.select(*fields)).withColumn("saved", F.unix_micros("saved"))
    grouped = every.groupBy(F.col("doc_key").cast("string").alias("doc_key")).agg(F.collect_list(F.struct(*fields[1:])).alias("marks"))
    taken = grouped.mapInArrow(run, "doc_key string, id string, pos int, anchor string, prefix string, saved long, excerpt string, is_resume boolean, place int, status string")
    return taken.withColumn("saved", F.timestamp_micros("saved"))


def merge_marks(ours: DataFrame, theirs: DataFrame, most: int | None = PER_DOC) -> DataFrame:
    """doc_key, id, pos, anchor, is_resume of two stores, at most `most` a document (ours first), all if it is None.

    One id with the same place and anchor is one mark; with another it keeps
    both, theirs as `id-altra-N` with the least N that neither store has given
    out for the id; a new id is added. A mark that ours holds as such a copy is
    not added again, so merging twice changes nothing. Our resume point wins.
    """
    spot = ["doc_key", "pos", "anchor"]
    copy = r"-altra-\d+$"
    held = ours.select(*[F.coalesce(F.col(c).cast("string"), F.lit("\x01")).alias(f"__{c}") for c in spot], F.col("id").alias("__id"), F.regexp_replace("id", copy, "").alias("__of"))
    same = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) == F.col(f"__{c}") for c in spot]
    new = theirs.join(held, [*same, (F.col("id") == F.col("__id")) | (F.col("id") == F.col("__of"))], "left_anti")
    numbers = ours.select("doc_key", "id").union(theirs.select("doc_key", "id")).where(F.col("id").rlike(copy))
    taken = numbers.groupBy("doc_key", F.regexp_replace("id", copy, "").alias("id")).agg(F.collect_set(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")).alias("taken"))
    clash = new.join(ours.select("doc_key", "id").distinct(), ["doc_key", "id"], "left_semi").join(taken, ["doc_key", "id"], "left")
    turn = F.row_number().over(Window.partitionBy("doc_key", "id").orderBy("pos", "anchor"))
    none = F.array().cast("array<bigint>")
    free = F.array_except(F.sequence(F.lit(1).cast("long"), F.size(F.coalesce("taken", none)) + F.col("turn")), F.coalesce("taken", none))
    copies = clash.withColumn("turn", turn).withColumn("id", F.concat("id", F.lit("-altra-"), F.element_at(free, F.col("turn")).cast("string")))
    new = new.join(ours.select("doc_key", "id"), ["doc_key", "id"], "left_anti").unionByName(copies.drop("taken", "turn"))
    has = ours.groupBy("doc_key").agg(F.max("is_resume").alias("has"))
    new = new.join(has, "doc_key", "left").withColumn("is_resume", F.col("is_resume") & ~F.coalesce("has", F.lit(False)))
    every = ours.select("doc_key", "id", "pos", "anchor", "is_resume", F.lit(0).alias("side")).unionByName(new.select("doc_key", "id", "pos", "anchor", "is_resume", F.lit(1).alias("side")))
    if most is None:
        return every.drop("side")
    n = F.row_number().over(Window.partitionBy("doc_key").orderBy("side", "pos", "id"))
    return every.withColumn("n", n).where(F.col("n") <= most).drop("n", "side")


def delete_marks(marks: DataFrame, gone: DataFrame) -> DataFrame:
    """marks without those of `gone` (doc_key, id); where the resume point goes, the mark nearest to it takes over."""
    lost = marks.where("is_resume").join(gone, ["doc_key", "id"], "left_semi").select("doc_key", F.col("pos").alias("lost"))
    left = marks.join(gone, ["doc_key", "id"], "left_anti").join(lost, "doc_key", "left")
    nearest = F.min_by("id", F.struct(F.abs(F.col("pos") - F.col("lost")), "pos", "id")).over(Window.partitionBy("doc_key"))
    return left.withColumn("is_resume", F.when(F.col("lost").isNotNull(), F.col("id") == nearest).otherwise(F.col("is_resume"))).drop("lost")


def trim_docs(marks: DataFrame, n: int = DOCS) -> DataFrame:
    """Marks of the `n` documents saved last."""
    latest = marks.groupBy("doc_key").agg(F.max("saved").alias("saved")).orderBy(F.desc_nulls_last("saved"), "doc_key").limit(n)
    return marks.join(latest.select("doc_key"), "doc_key", "left_semi")


def describe_marks(marks: DataFrame) -> DataFrame:
    """marks in reading order with place_no, total and label."""
    order = Window.partitionBy("doc_key").orderBy("pos", "id")
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_key"))
    out = marks.withColumn("place_no", F.row_number().over(order)).withColumn("total", total)
    return out.withColumn("label", F.concat(F.col("place_no").cast("string"), F.lit(" di "), F.col("total").cast("string"), F.lit(": "), F.col("excerpt"), F.when(F.col("is_resume"), " (ripresa)").otherwise("")))


def media_marks(marks: DataFrame) -> DataFrame:
    """Media marks (media, id, sec, name, ts, is_resume) by second, with place_no and last (the resume mark, else the newest)."""
    order = Window.partitionBy("media").orderBy("sec", "id")
    every = Window.partitionBy("media")
    last = F.max_by("id", F.struct(F.col("is_resume").cast("int"), "ts", "id")).over(every)
    return marks.withColumn("place_no", F.row_number().over(order)).withColumn("last", F.col("id") == last)


def rename_media_mark(marks: DataFrame, names: DataFrame) -> DataFrame:
    """marks with new names (media, id, new_name); a blank one keeps the old."""
    joined = marks.join(names, ["media", "id"], "left")
    return joined.withColumn("name", F.coalesce(F.nullif(F.trim("new_name"), F.lit("")), "name")).select(*marks.columns)


def delete_media_marks(marks: DataFrame, gone: DataFrame) -> DataFrame:
    """marks without those of `gone` (media, id); a lost resume point goes to the last mark by second."""
    lost = marks.where("is_resume").join(gone, ["media", "id"], "left_semi").select("media", F.lit(True).alias("lost"))
    left = marks.join(gone, ["media", "id"], "left_anti").join(lost, "media", "left")
    final = F.max_by("id", F.struct("sec", "id")).over(Window.partitionBy("media"))
    return left.withColumn("is_resume", F.when(F.col("lost"), F.col("id") == final).otherwise(F.col("is_resume"))).drop("lost")
