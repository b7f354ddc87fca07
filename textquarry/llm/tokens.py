"""Token counts by a public tokenizer, with overlap resynchronisation of huge documents.

Documents up to HUGE characters are counted whole. Of a longer one, overlapping
chunks are encoded with offsets, each chunk in a row of its own, so one document
spreads over tasks. Two neighbours are spliced where both start a pre-token at
the same place in their overlap, MARGIN away from either end. Such a place is
proven stable: the tokenizer's pattern reads left to right without looking
back, and nothing that it looks ahead for (or a special string) is longer than
MARGIN, so before it the left chunk, and after it the right chunk, hold the
tokens of the whole text. Documents whose chunks share no such place (a word
longer than the overlap) are cut anew with an overlap 16 times as wide, until
the whole document is one chunk.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut
from ._words import batches, claim, remembers

HUGE, CHUNK, OVERLAP, MARGIN, WIDEN = 1 << 15, 1 << 14, 1 << 10, 64, 16
KNOWN, ENTRY = 32 << 20, 160  # bytes of what a worker remembers in each of two generations; of them, what an entry takes beside its key


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """What a worker remembers by key: two generations of about `most` bytes each, so that keys in use stay."""

    def __init__(self, most: int = KNOWN) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0
        self.most = most

    def learn(self, keys: set, make: Callable[[list], list]) -> dict:
        """A table that holds all the keys; `make` gives values of those not known."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = []
        for k in keys - self.young.keys():
            if k in self.old:
                self.young[k] = self.old[k]
                self.size += ENTRY + len(k)
            else:
                new.append(k)
        self.young.update(zip(new, make(new), strict=True))
        self.size += sum(ENTRY + len(k) for k in new)
        return self.young


@functools.cache
def known_words(path: str) -> Memo:
    return Memo()


remembers(known_words.cache_clear)


def count_whole(path: str, texts: list[bytes]) -> list[int]:
    """Tokens of each text. No token spans ASCII white space, so a text has the tokens of its words; a worker encodes a word once."""
    words = [t.split() for t in texts]

    def count(new: list[bytes]) -> list[int]:
        return [len(e) for e in tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]

    known = known_words(path).learn({w for own in words for w in own}, count)
    return [sum(map(known.__getitem__, own)) for own in words]


def _count(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        for batch in parts:
            for part, texts in batches(batch):
                yield part.drop_columns(["text"]).append_column("n_tokens", pa.array(count_whole(path, texts), pa.int64()))

    return run


def _chunks(chunk: int, overlap: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                text, at, no = row["text"], 0, 0
                while True:
                    end = len(text) if at + chunk + overlap >= len(text) else at + chunk
                    yield pa.RecordBatch.from_pylist([{"id": row["id"], "hash": row["hash"], "no": no, "at": at, "last": end == len(text), "text": text[at:end]}], CHUNK_SCHEMA)
                    if end == len(text):
                        break
                    at, no = end - overlap, no + 1

    return run


CHUNK_SCHEMA = pa.schema({"id": pa.int64(), "hash": pa.int64(), "no": pa.int32(), "at": pa.int64(), "last": pa.bool_(), "text": pa.string()})
ZONES = "left_at array<long>, left_n array<int>, right_at array<long>, right_n array<int>"


def _encode(path: str, overlap: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        for batch in parts:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                found = tokenizer(path).encode(row["text"], add_special_tokens=False)
                words, starts = np.array(found.word_ids, object), np.array([a for a, _ in found.offsets], np.int64)
                first = np.flatnonzero(words[1:] != words[:-1]) + 1  # tokens that start a pre-token
                n = len(row["text"])
                zones = [first[(starts[first] >= lo + MARGIN) & (starts[first] <= lo + overlap - MARGIN)] for lo in (0, n - overlap)]
                left, right = (zones[0] if row["no"] else zones[0][:0]), (zones[1][:0] if row["last"] else zones[1])
                at = row.pop("at")
                row.pop("text")
                row |= {"n": len(found.ids), "left_at": (starts[left] + at).tolist(), "left_n": left.tolist(), "right_at": (starts[right] + at).tolist(), "right_n": right.tolist()}
                yield pa.RecordBatch.from_pylist([row], OUT_SCHEMA)

    return run


OUT_SCHEMA = pa.schema([*(f for f in CHUNK_SCHEMA if f.name not in ("at", "text")), pa.field("n", pa.int32()), *(pa.field(n, pa.list_(pa.int64() if n.endswith("at") else pa.int32())) for n in ("left_at", "left_n", "right_at", "right_n"))])


def splice(encoded: DataFrame) -> DataFrame:
    """Per (id, hash): n_tokens, or null where two neighbours share no stable boundary."""
    order = Window.partitionBy("id", "hash").orderBy("no")
    spliced = encoded.withColumn("next_at", F.lead("left_at").over(order)).withColumn("next_n", F.lead("left_n").over(order))
    at = F.element_at(F.array_intersect("right_at", "next_at"), F.lit(1))

    def before(n: str, where: str) -> F.Column:
        return F.element_at(F.col(n), F.array_position(F.col(where), F.col("stable")).cast("int"))

    spliced = spliced.withColumn("stable", F.when(~F.col("last") & (F.size(F.array_intersect("right_at", "next_at")) > 0), at))
    part = F.when(F.col("last"), F.col("n")).when(F.col("stable").isNotNull(), before("right_n", "right_at") - before("next_n", "next_at"))
    sums = spliced.groupBy("id", "hash").agg(F.sum(part).alias("n_tokens"), F.bool_and(part.isNotNull()).alias("whole"))
    return sums.select("id", "hash", F.when(F.col("whole"), F.col("n_tokens")).cast("long").alias("n_tokens"))


def count_huge(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per distinct row (id, hash, text): id, hash, n_tokens."""
    rows, done = rows.dropDuplicates(["id", "hash"]), None
    while True:
        pieces = rows.mapInArrow(_chunks(max(chunk, 4 * overlap), overlap), "id long, hash long, no int, at long, last boolean, text string")
        encoded = pieces.repartition("hash", "no").mapInArrow(_encode(path, overlap), f"id long, hash long, no int, last boolean, n int, {ZONES}")
        found = cut(splice(encoded), "token-splices")
        whole = found.where("n_tokens IS NOT NULL")
        done = whole if done is None else done.unionByName(whole)
        failed = found.where("n_tokens IS NULL").select("id", "hash")
        if failed.isEmpty():
            return done
        rows = rows.join(failed.select(F.col("id").alias("i"), F.col("hash").alias("h")), F.col("hash").eqNullSafe(F.col("h")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
        overlap *= WIDEN


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the whole text as the library's default gives them,
    without added special tokens, padding or truncation; null counts as empty
    and has none. Repeated rows and null ids are counted row by row; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > huge
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.where(~long).mapInArrow(_count(path), "id long, n_bytes long, n_tokens long")
    giants = rows.where(long).withColumn("hash", F.xxhash64("text"))
    counted = count_huge(giants.select("id", "hash", "text"), path, chunk, overlap)
    own = giants.select("id", "hash", "n_bytes").join(counted.select(F.col("id").alias("i"), F.col("hash").alias("h"), "n_tokens"), F.col("hash").eqNullSafe(F.col("h")) & F.col("id").eqNullSafe(F.col("i")), "left")
    every = short.unionByName(own.select("id", "n_bytes", "n_tokens"))
    return every.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
