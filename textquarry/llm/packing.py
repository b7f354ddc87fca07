"""Cost-balanced packing of tokenized documents into sequences.

A task packs the documents that it reads in groups of about GROUP tokens, so
packing needs no exchange and a group's memory is bounded. Whole lengths of a
document fill sequences of their own; its rest goes to the group. A group opens
as many full sequences as its rests fill, and for what is left over sequences
of powers of two, which need no padding. Rests go in descending length to the
sequence with the lowest cost (linear in tokens plus quadratic in each piece,
as attention is) that has room; one that fits nowhere is cut over those with
most room. Sequence ids hold the task's number and a counter, so a task that
runs again gives the same ids.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import claim, remembers
from .tokens import Memo, tokenizer

SIZE, GROUP = 2048, 1 << 21
BATCH, BATCH_BYTES = 512, 8 << 20  # documents tokenized at a time, and about how many bytes of text
REMEMBERED = 96 << 20  # bytes of units that a worker remembers in each of two generations
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the blank before it, or white space up to that blank: each holds whole pre-tokens of a byte-level BPE.
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BLANK = re.compile(f"[{WHITE}]")
PIECE_SCHEMA = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()})


@functools.cache
def known_units(path: str, most: int) -> Memo:
    return Memo(most)


remembers(known_units.cache_clear)


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode_units(path: str, units: list[str]) -> list[bytes]:
    """Ids of each unit. Units without white space inside are encoded some hundred at a time, a line each: a line break is a token of its own between them."""
    own, out = tokenizer(path), dict.fromkeys(units, b"")
    (line_break,) = own.encode("\n", add_special_tokens=False).ids
    plain = [u for u in units if not BLANK.match(u[-1])]
    rest = [u for u in units if BLANK.match(u[-1])]
    groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
    for group, found in zip(groups, own.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(found.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == line_break), len(ids)).tolist()
        flat = ids.tobytes()
        out.update(zip(group, (flat[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)), strict=True))
    for unit, found in zip(rest, own.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        out[unit] = packed_ids(found.ids)
    return [out[u] for u in units]


def token_ids(path: str, texts: list[str], remembered: int) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers. A worker encodes a unit once; texts with special strings are encoded whole."""
    special = special_strings(path)
    units = [None if any(s in t for s in special) else UNITS.findall(t) for t in texts]
    known = known_units(path, remembered).learn(set().union(*(found for found in units if found)), functools.partial(encode_units, path))
    return [packed_ids(tokenizer(path).encode(t, add_special_tokens=False).ids) if found is None else b"".join(map(known.__getitem__, found)) for t, found in zip(texts, units, strict=True)]


def assign(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that place items, each shorter than `size`, without padding."""
    total = sum(lengths)
    tail = total % size
    room = np.array([size] * (total // size) + [1 << b for b in range(size.bit_length()) if tail >> b & 1], np.int64)
    used, cost, pieces = np.zeros_like(room), np.zeros(len(room)), []

    def put(item: int, start: int, length: int, k: int) -> None:
        pieces.append((item, start, length, k, int(used[k])))
        used[k] += length
        room[k] -= length
        cost[k] += linear * length + quadratic * length * length

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length, start = lengths[item], 0
        fits = np.flatnonzero(room >= length)
        if len(fits):
            put(item, 0, length, int(fits[np.argmin(cost[fits])]))
            continue
        while start < length:
            k = int(np.argmax(room))
            part = min(int(room[k]), length - start)
            put(item, start, part, k)
            start += part
    return pieces


def portions(batch: pa.RecordBatch, most: int = BATCH, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (doc_id, text) of at most `most` rows and about `size` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        over = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(at + most, max(over, at + 1))
        yield batch.slice(at, end - at)
        at = end


def _pack(path: str, end_id: int, size: int, group: int, linear: float, quadratic: float, remembered: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        base, counter = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        rests: list[tuple] = []  # doc_id, ids of the rest, its start, the document's tokens
        waiting = 0

        def row(doc, ids: bytes, start: int, total: int, sequence: int, offset: int) -> None:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + sequence, offset))

        def flush() -> None:
            nonlocal counter, waiting
            placed = assign([len(x[1]) // 4 for x in rests], size, linear, quadratic)
            for item, start, length, k, offset in placed:
                doc, ids, first, total = rests[item]
                row(doc, ids[4 * start : 4 * (start + length)], first + start, total, counter + k, offset)
            counter += max((x[3] for x in placed), default=-1) + 1
            rests.clear()
            waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)
                rows.clear()

        for batch in parts:
            for part in portions(batch):
                docs, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(docs, token_ids(path, texts, remembered), strict=True):
                    ids += packed_ids([end_id])
                    total = len(ids) // 4
                    full = total // size * size
                    for start in range(0, full, size):
                        row(doc, ids[4 * start : 4 * (start + size)], start, total, counter, 0)
                        counter += 1
                    if total > full:
                        rests.append((doc, ids[4 * full :], full, total))
                        waiting += total - full
                    if waiting >= group:
                        flush()
                yield from out()
        flush()
        yield from out()

    return run


def pack_sequences(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, group: int = GROUP, linear: float = LINEAR, quadratic: float = QUADRATIC, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and `end_id`. Each id lies in exactly one piece;
    a sequence's pieces are gapless from 0 and hold `size` tokens or a power of
    two below it. Null or empty text is `end_id` alone; repeated rows and rows
    without an id are packed row by row; an empty table has no pieces; other
    columns are ignored. A worker remembers the ids of `remembered` bytes of
    words, and of as many before those; less takes more time, not other ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(path, end_id, size, group, linear, quadratic, remembered), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
