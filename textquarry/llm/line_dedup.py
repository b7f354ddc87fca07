"""Line dedup with two Bloom filters, partitioned by slices of the hashes.

Documents are dealt into blocks. A block sends the hashes of its lines, packed,
to the owners of their slices. An owner marks them in a filter for lines seen
once and one for lines seen twice, and answers each block which of its hashes
the twice filter holds. A filter is as large as the hashes that its owner gets
ask for; more lines make more slices, so the filters never fill up, and nobody
holds all of them. Only lines that the answers suspect are sent on: their keys
are grouped as text, which confirms repeats exactly and gives the first
document; the filters' errors only add suspects. The numbers of the lines to
drop then meet the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, exchange_width, text_bytes
from ._words import U, claim
from .scoring import pack_keys, unpack_keys

BLOCK_BYTES, SLICE_BYTES = 8 << 20, 32 << 20  # of texts whose lines a block holds, or a slice's owner marks
BITS_PER_KEY, LEAST_BITS = 16, 1 << 12
SPACE = b" \t\n\r\x0b\x0c"


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """Per line its key, or None if the key has fewer than `least` code points."""
    keys = [line.strip(SPACE).lower() for line in text.split(b"\n")]
    return [k if len(k) >= 4 * least or len(k) >= least and len(k.decode()) >= least else None for k in keys]


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each hash, from its halves."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits - 1).bit_length())]).astype(np.int64)


def held(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(axis=0)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at.ravel() >> 3, np.uint8(1) << (at.ravel() & 7).astype(np.uint8))


def block_keys(table: pa.Table, least: int) -> tuple[list[list[bytes | None]], np.ndarray, np.ndarray]:
    """Line keys of each text of a block, the distinct hashes of them all, ascending, and whether more than one document holds each."""
    keys = [line_keys(text or b"", least) for text in table.column("text").cast(pa.binary()).to_pylist()]
    found = [xxhash.xxh3_64_intdigest(k) for own in keys for k in {*own} if k is not None]
    hashes, n = np.unique(np.array(found, U), return_counts=True)
    return keys, hashes, n > 1


ASKED = pa.schema({"slice": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "often": pa.binary()})
ANSWERED = pa.schema({"slice": pa.int32(), "block": pa.int64(), "twice": pa.binary(), "sign": pa.int64()})
SUSPECTED = pa.schema({"line_doc": pa.int64(), "line_text": pa.int64(), "line_no": pa.int32(), "line_key": pa.string()})


def signs(keys: list[np.ndarray]) -> np.ndarray:
    """A number for each set of keys, by which both ends of an answer know that they mean the same ones."""
    return np.array([np.bitwise_xor.reduce(k, initial=U(len(k))) for k in keys], U).view(np.int64)


def _ask(bits: int, least: int):
    """A block's hashes for the owners of 2**bits slices."""

    def run(table: pa.Table) -> pa.Table:
        claim("lines")
        _, hashes, often = block_keys(table, least)
        part = (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        block = table.column("block")[0].as_py()
        rows = [(int(part[a]), block, pack_keys(hashes[a:b]), np.packbits(often[a:b]).tobytes()) for a, b in zip(starts, np.append(starts[1:], len(hashes)), strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, ASKED, strict=True)], schema=ASKED)

    return run


def _answer(size: int | None):
    """A slice's owner: both filters, and for each block which of its hashes are held twice."""

    def run(table: pa.Table) -> pa.Table:
        claim("lines")
        keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        bits = size or max(LEAST_BITS, 1 << (BITS_PER_KEY * sum(map(len, keys)) - 1).bit_length())
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for own, often in zip(keys, table.column("often").to_pylist(), strict=True):
            at = positions(own, bits)
            put(twice, at[:, np.unpackbits(np.frombuffer(often, np.uint8))[: len(own)].astype(bool) | held(once, at)])
            put(once, at)
        told = [np.packbits(held(twice, positions(own, bits))).tobytes() for own in keys]
        return pa.table([table.column("slice"), table.column("block"), pa.array(told, pa.binary()), pa.array(signs(keys))], schema=ANSWERED)

    return run


def _suspect(bits: int, least: int):
    """The lines of a block that the answers to it suspect."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        claim("lines")
        keys, hashes, _ = block_keys(docs, least)
        told = answers.sort_by("slice")
        part = (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        sizes = np.bincount(part, minlength=1 << bits)
        own = [x for x in np.split(hashes, np.cumsum(sizes)[:-1]) if len(x)]
        if signs(own).tolist() != told.column("sign").to_pylist():
            raise RuntimeError("the rows of a block are not those that asked: its documents must not change between reads")
        flags = [np.unpackbits(np.frombuffer(t, np.uint8))[: sizes[k]] for k, t in zip(told.column("slice").to_pylist(), told.column("twice").to_pylist(), strict=True)]
        twice = {*hashes[np.concatenate([*flags, np.empty(0, np.uint8)]).astype(bool)].tolist()}
        rows = [(i, no, k) for i, own in enumerate(keys) for no, k in enumerate(own) if k is not None and xxhash.xxh3_64_intdigest(k) in twice] if twice else []
        at = pa.array([r[0] for r in rows], pa.int64())
        found = [docs.column("line_doc").take(at), docs.column("line_text").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found], schema=SUSPECTED)

    return run


def _apply(text_at: int, drop_at: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in parts:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            drops = batch.column(drop_at).to_pylist()
            kept, total, gone = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                text = text or b""
                total.append(text.count(b"\n") + 1)
                gone.append(len(drop or ()))
                if drop:
                    out = {*drop}
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out)
                kept.append(text)
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != drop_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def suspected_lines(rows: DataFrame, least: int, bits: int | None = None) -> DataFrame:
    """Lines of rows (line_doc, line_text, text) that more than one document may hold: line_doc, line_text, line_no, line_key."""
    spark = rows.sparkSession
    size = text_bytes(rows)
    blocks = max(1, -(-size // BLOCK_BYTES))
    slices = max(0, (-(-size // SLICE_BYTES) - 1).bit_length())
    # rows alike are spread as they are read
    block = F.pmod(F.xxhash64("line_doc", "line_text", F.spark_partition_id()), F.lit(blocks))
    dealt = rows.withColumn("block", block).repartition(exchange_width(spark, size, BLOCK_BYTES), "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(slices, least), "slice int, block long, keys binary, often binary")
    answered = asked.groupBy("slice").applyInArrow(_answer(bits), "slice int, block long, twice binary, sign long")
    suspects = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_suspect(slices, least), "line_doc long, line_text long, line_no int, line_key string")
    return cut(suspects, "line-suspects")


def repeated_lines(suspects: DataFrame) -> DataFrame:
    """Lines to drop among suspected ones: line_doc, line_text (hash of the text), drop (their numbers)."""
    ends = suspects.groupBy("line_key").agg(F.min("line_doc").alias("first_doc"), F.max("line_doc").alias("last_doc"))
    # a table of its own, so that the rows of a very common line may be split over tasks
    ends = cut(ends.where("first_doc < last_doc").drop("last_doc"), "line-repeats")
    return suspects.join(ends, "line_key").where("line_doc > first_doc").groupBy("line_doc", "line_text").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = 10, bits: int | None = None) -> DataFrame:
    """`docs` with repeated lines removed from text, and n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least `least` code points in at least 2 documents lose their
    lines everywhere but in the smallest doc_id that holds them; there they all
    stay. Null or empty text is one empty line. Rows with one doc_id count as
    one document; rows without one as one that comes last. An empty table gives
    an empty result; columns named n_lines or n_dropped are replaced, those that
    start with `__line` left out. `bits` sets the size of each slice's filters,
    for tests.
    """
    docs = docs.drop("n_lines", "n_dropped", *[c for c in docs.columns if c.startswith("__line")])
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text"))
    rows = docs.select(keys[0].alias("line_doc"), keys[1].alias("line_text"), "text")
    drops = repeated_lines(suspected_lines(rows, least, bits)).toDF("__line_doc", "__line_text", "__line_drop")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = docs.withColumn("__line_doc", keys[0]).withColumn("__line_text", keys[1])
    joined = keyed.join(drops, ["__line_doc", "__line_text"], "left").select(*docs.columns, "__line_drop")
    told = joined.mapInArrow(_apply(docs.columns.index("text"), len(docs.columns)), f"{fields}, n_lines long, n_dropped long")
    return told.withColumn("text", F.coalesce("text", F.lit("")))
