"""Exact dedup with an extendible-hash index on shared files.

Entries (key, digest, row) are written to the shared folder. A directory over
the leading bits of the key doubles where a bucket holds more entries than its
capacity, so every bucket covers one range of keys. Texts whose key more than
one row holds go, copies collapsed, to the bucket that the directory names. The
bucket's owner task walks it in key order and chains the texts of one key: a
text joins the link whose bytes are its own, or is a collision and opens a new
one. What the owners write is the index; rows look their link up in it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut, exchange_width
from ._words import batches, claim

CAPACITY = 65536
HELD = 32 << 20  # bytes of texts that a task holds to collapse copies
BUCKETS_PER_TASK = 4
ENTRY = pa.schema({"bucket": pa.int64(), "depth": pa.int32(), "key": pa.int64(), "text": pa.binary(), "n": pa.int64(), "points": pa.int64(), "doc_id": pa.int64(), "best": pa.int64()})
LINK = pa.schema({"key": pa.int64(), "link": pa.int32(), "sha": pa.binary(), "group_size": pa.int64(), "keep_points": pa.int64(), "keep_id": pa.int64(), "best": pa.int64(), "bucket": pa.int64(), "depth": pa.int32()})


def normalised(text: Column) -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def directory(keys: DataFrame, capacity: int, fine_bits: int) -> DataFrame:
    """Slot (leading `fine_bits` of the key) to depth and bucket, from keys and their numbers of entries (key, n).

    Starting from one bucket, depth grows by one bit wherever the bucket still
    has more than `capacity` entries: the bucket of a slot is its shortest prefix
    that fits. A slot that never fits keeps the full depth and its chain.
    """
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - fine_bits).alias("slot")).agg(F.sum("n").alias("n"))
    levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(fine_bits))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {fine_bits} - depth)"))
    full = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = levels.join(full, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == fine_bits))
    return fits.groupBy("slot").agg(F.min("depth").alias("depth")).withColumn("bucket", F.expr(f"shiftleft(1L, depth) + shiftright(slot, {fine_bits} - depth)"))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (rows, points, doc_id, rows that are best): their sum. More points are better, then the smaller id, null last."""
    rank = lambda x: (-x[1], x[2] is None, x[2] or 0)
    if rank(a) == rank(b):
        return a[0] + b[0], a[1], a[2], a[3] + b[3]
    best = a if rank(a) < rank(b) else b
    return a[0] + b[0], *best[1:]


def _collapse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that one task reads as one entry: bucket, depth, key, text, and what `_better` makes of its rows."""
    claim("dedup")
    found: dict[tuple, tuple] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(b, d, k, text, *best) for (b, d, k, text), best in found.items()]
        found.clear()
        for i in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1024], strict=True), ENTRY, strict=True)], schema=ENTRY)

    for batch in parts:
        for part, texts in batches(batch):
            columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("bucket", "depth", "key", "points", "doc_id"))
            for bucket, depth, key, points, doc_id, text in zip(*columns, texts, strict=True):
                name, own = (bucket, depth, key, text), (1, points, doc_id, 1)
                if name in found:
                    found[name] = _better(found[name], own)
                else:
                    found[name] = own
                    size += len(text) + 200
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's buckets in key order: per key its chain of links, texts compared byte by byte."""
    claim("dedup")
    chain: list[list] = []  # of the key at hand: text, what `_better` makes of its rows
    at: tuple | None = None
    rows: list[tuple] = []

    def close() -> None:
        shas = [hashlib.sha256(text).digest() for text, _ in chain]
        if len({*shas}) < len(shas):
            raise ValueError("two texts share a SHA-256")
        for link, (sha, (_, best)) in enumerate(zip(shas, chain, strict=True)):
            rows.append((at[1], link, sha, *best, at[0], at[2]))
        chain.clear()

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(LINK), LINK, strict=True)], schema=LINK)
        rows.clear()
        return found

    for batch in parts:
        for part, texts in batches(batch):
            columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("bucket", "key", "depth", "n", "points", "doc_id", "best"))
            for bucket, key, depth, n, points, doc_id, best, text in zip(*columns, texts, strict=True):
                if at != (bucket, key, depth):
                    close()
                    at = (bucket, key, depth)
                for link in chain:
                    if link[0] == text:
                        link[1] = _better(link[1], (n, points, doc_id, best))
                        break
                else:
                    chain.append([text, (n, points, doc_id, best)])
            yield out()
    close()
    yield out()


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth and link (null for a text held once).

    Texts are equal when identical after deleting white space. The row with the
    most code points in its original text stays, then the smallest doc_id (null
    ids last); of rows that repeat in both, one is kept. Null text is empty and
    equal to other empty texts; an empty table gives an empty result; other
    columns are ignored. Fewer `key_bits` force collisions, for tests.
    """
    spark = docs.sparkSession
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised(F.col("text")).alias("norm"))
    key = F.xxhash64("norm") if key_bits == 64 else F.shiftleft(F.pmod(F.xxhash64("norm"), F.lit(1 << key_bits)), 64 - key_bits)
    entries = cut(row.select("doc_id", "points", key.alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-entries")

    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    n = entries.count()
    fine_bits = min(24, max(1, math.ceil(math.log2(max(2, n / capacity))) + 4))
    slots = cut(directory(keys, capacity, fine_bits), "dedup-directory")
    repeated = keys.where("n > 1").withColumn("slot", F.shiftrightunsigned("key", 64 - fine_bits)).join(broadcast_if(slots), "slot")
    repeated = cut(repeated.select("key", "bucket", "depth"), "dedup-repeated")

    suspects = row.withColumn("key", key).join(broadcast_if(repeated), "key").select("bucket", "depth", "key", F.col("norm").alias("text"), "points", "doc_id")
    collapsed = suspects.mapInArrow(_collapse, _ddl(ENTRY))
    width = exchange_width(spark, n, BUCKETS_PER_TASK * capacity)
    links = cut(collapsed.repartition(width, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own, _ddl(LINK)), "dedup-links")

    found = entries.join(broadcast_if(links.where("group_size > 1")), ["key", "sha"], "left")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    found = found.withColumn("kept", F.col("link").isNull() | first)
    # rows alike in id and length, of which one stays, are ranked; they are few
    alike = found.where("kept AND best > 1")
    turn = F.row_number().over(Window.partitionBy("key", "sha").orderBy("points"))
    every = found.where("NOT kept OR best IS NULL OR best = 1").unionByName(alike.withColumn("kept", turn == 1))
    return every.select(
        "doc_id",
        F.when(F.col("link").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "depth",
        "link",
    )
