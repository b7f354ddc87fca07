"""Language-model scores by stupid backoff.

Documents are dealt into blocks by a hash. A block explodes its texts into
n-grams and asks for the counts of its distinct ones: one row per block, order
and range of hashes, the hashes and the block's own counts as packed columns.
Grouped by range, the rows are the n-gram count table of that range; summing
them answers each block in the order it asked. Blocks join the answers and sum
log scores per document. Hashes travel packed and once per block, since a row
per n-gram and document would move several times the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import exchange_width, text_bytes
from ._words import U, claim, hash_words, runs
from .mixing import word_count

ORDER, BACKOFF, LEAST_COUNT = 2, 0.4, 2
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first whole, then gaps of 6 bytes, or of 8 if one needs more (the first byte tells)."""
    gaps = np.diff(keys)
    wide = bool((gaps >> U(48)).any())
    body = gaps.tobytes() if wide else gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return bytes([wide]) + keys[:1].tobytes() + body


def unpack_keys(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    body = data[9:].reshape(-1, 8 if data[0] else 6)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[0] = data[1:9]
    gaps[1:, : body.shape[1]] = body
    return np.cumsum(gaps.view(U).ravel(), dtype=U)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers, or 64-bit ones if one needs more (the first byte tells)."""
    wide = bool((counts >> 32).any())
    return bytes([wide]) + counts.astype("<u8" if wide else "<u4").tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[1:], "<u8" if packed[0] else "<u4").astype(np.int64)


def texts_of(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def grams(words: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within texts, and the places of their last words."""
    if order == 1:
        return words, np.arange(len(words))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.flatnonzero(place >= order - 1)
    return runs(words, order)[last - order + 1], last


def _ask(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        claim("scoring")
        words, counts = hash_words(texts_of(table))
        block = table.column("block")[0].as_py()
        rows = []
        for k in range(1, order + 1):
            keys, n = np.unique(grams(words, counts, k)[0], return_counts=True)
            part = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            starts = np.flatnonzero(np.diff(part, prepend=-1))  # of the ranges that the block has n-grams in
            rows += [(k, int(part[a]), block, pack_keys(keys[a:b]), pack_counts(n[a:b])) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, ASKED.types, strict=True)], schema=ASKED)

    return run


ASKED = pa.schema({"gram": pa.int32(), "part": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "counts": pa.binary()})
ANSWERED = pa.schema({"gram": pa.int32(), "part": pa.int32(), "block": pa.int64(), "counts": pa.binary()})


def _answer(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    own = np.concatenate([unpack_counts(c) for c in table.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=own).astype(np.int64)[at]
    parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table([table.column("gram"), table.column("part"), table.column("block"), pa.array([pack_counts(p) for p in parts], pa.binary())], schema=ANSWERED)


SCORED = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "log_score": pa.float64()})


def _score(order: int, backoff: float, least: int, total: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        claim("scoring")
        words, counts = hash_words(texts_of(docs))
        order_rows = answers.sort_by([("gram", "ascending"), ("part", "ascending")])
        by_gram: dict[int, list[np.ndarray]] = {}
        for k, c in zip(order_rows.column("gram").to_pylist(), order_rows.column("counts").to_pylist(), strict=True):
            by_gram.setdefault(k, []).append(unpack_counts(c))
        held = np.zeros((order, len(words)))  # count of the k-gram that ends at each word
        score = np.empty(0)
        for k in range(1, order + 1):
            keys, last = grams(words, counts, k)
            if not len(keys):
                continue
            held[k - 1, last] = np.concatenate(by_gram[k])[np.unique(keys, return_inverse=True)[1]]
            if k == 1:
                score = np.log(held[0] / total)
                continue
            found = held[k - 1, last]
            seen = found >= least
            context = held[k - 2, last - 1]
            score[last] = np.where(seen, np.log(np.where(seen, found, 1)) - np.log(np.where(seen, context, 1)), math.log(backoff) + score[last])
        owner = np.repeat(np.arange(docs.num_rows), counts)
        return pa.table([docs.column("doc_id"), pa.array(counts), pa.array(np.bincount(owner, weights=score, minlength=docs.num_rows))], schema=SCORED)

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, log_score, mean_log_score.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; counts are over all
    rows. The score of a word after its context is count / count of context for
    n-grams seen `least` times or more, else `backoff` times the score of the
    next lower order, down to count / number of words; log_score is the sum of
    natural logs. The first words of a text have the order that fits, without a
    penalty. Null or empty text has no words, log_score 0 and a null mean.
    Repeated rows count and are scored each; null ids are scored; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(0, (-(-size // RANGE_BYTES) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    dealt = rows.repartition(exchange_width(spark, size, BLOCK_BYTES), "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(order, bits), "gram int, part int, block long, keys binary, counts binary")
    answered = asked.groupBy("part", "gram").applyInArrow(_answer, "gram int, part int, block long, counts binary")
    total = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 1
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(order, backoff, least, total), "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))
