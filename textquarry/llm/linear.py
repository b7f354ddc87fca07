"""Hashed-text features and the small linear fits of the classifiers.

A document's features are the distinct hashed words it holds (ASCII punctuation
separates words), their first letters, and, of its shape, one bucket each of a few ratios. Fits use a
bounded sample of labelled rows and the most telling features of that sample;
scoring runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut
from ._words import batches, claim, hash_words

SPACE_BITS = 18
PREFIXES = (4, 5)  # first bytes of a word that are features too: stems, in any language
SHAPES, BUCKETS = 6, 16
FEATURES = (1 << SPACE_BITS) + SHAPES * BUCKETS
SAMPLE, SELECTED = 8192, 256
LEAST_SCORE = 15.0  # chi-square that chance gives one feature in ten thousand

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all distinct features of each text, rows ascending. A text without words has its shape alone."""
    hashes, counts = hash_words(texts, marks=True, prefixes=PREFIXES)
    words = hashes[0]
    owner = np.repeat(np.arange(len(texts)), counts)
    slots = (hashes >> np.uint64(64 - SPACE_BITS)).astype(np.int64)
    distinct = np.bincount(np.unique(owner * FEATURES + slots[0]) // FEATURES, minlength=len(texts))
    pairs = np.unique((owner * FEATURES + slots).ravel())
    again = np.zeros(len(texts), np.int64)
    if len(words) > 1:
        np.add.at(again, owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], 1)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    kinds = []
    for table in (_UPPER, _MARK, _DIGIT):
        total = np.concatenate([[0], np.cumsum(table[data])])
        kinds.append(total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)])
    size, n = np.maximum(1, [len(t) for t in texts]), np.maximum(1, counts)
    ratios = [kinds[0] / size, kinds[1] / size, kinds[2] / size, distinct / n, again / n, np.minimum(1, size / n / 32)]
    shape = [np.arange(len(texts)) * FEATURES + (1 << SPACE_BITS) + k * BUCKETS + np.minimum(BUCKETS - 1, np.sqrt(r) * BUCKETS).astype(np.int64) for k, r in enumerate(ratios)]
    pairs = np.sort(np.concatenate([pairs, *shape]))
    return pairs // FEATURES, pairs % FEATURES


def _featurise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for part, texts in batches(batch):
            rows, found = features(texts)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int32)
            yield part.drop_columns(["text"]).append_column("features", pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32))))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, Column], bound: int = SAMPLE) -> DataFrame:
    """doc_id, `columns` (expressions over labels, as int) and features of at most `bound` labelled documents, chosen by a hash of their id; of rows with one id, one text. Written to the shared folder."""
    used = [c for c in labels.columns if c != "doc_id"]
    chosen = labels.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(bound)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id", *used)), "doc_id")
    one = picked.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), *[F.first(c).alias(c) for c in used])
    out = [F.coalesce(e.cast("int"), F.lit(0)).alias(c) for c, e in columns.items()]
    fields = ", ".join(f"`{c}` int" for c in columns)
    return cut(one.select("doc_id", "text", *out).mapInArrow(_featurise, f"doc_id long, {fields}, features array<int>"), "labelled-sample")


def select_features(sample: DataFrame, target: Column, most: int = SELECTED) -> np.ndarray:
    """The `most` features with the largest chi-square against `target`, none that chance explains; of ties, the smallest. At most `most` rows reach the driver."""
    yes = F.coalesce(target.cast("int"), F.lit(0))
    n, p = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(yes), F.lit(0))).first()
    if not n:
        return np.empty(0, np.int64)
    counts = sample.select(yes.alias("yes"), F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("held"), F.sum("yes").alias("hits"))
    expected = F.col("held") * (p / n)
    spread = expected * (1 - F.col("held") / n) * (1 - p / n) + 1e-9
    best = counts.where("held >= 2").select("feature", ((F.col("hits") - expected) ** 2 / spread).alias("score")).where(F.col("score") >= LEAST_SCORE)
    return np.array(sorted(r[0] for r in best.orderBy(F.desc("score"), "feature").limit(most).collect()), np.int64)


def dense(sample: DataFrame, chosen: np.ndarray, columns: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows by chosen features of the sample, by ascending doc_id, and `columns`: at most its bound times `chosen` numbers."""
    own = F.array_intersect("features", F.array(*[F.lit(int(f)) for f in chosen]).cast("array<int>"))
    rows = sample.select("doc_id", *columns, own.alias("own")).toArrow()
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")]))
    place = {int(f): i for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, found in enumerate(rows.column("own").to_pylist()):
        x[i, [place[f] for f in found]] = 1
    return x, {c: rows.column(c).to_numpy() for c in columns}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 150, rate: float = 0.2) -> np.ndarray:
    """Adam from `start` with a rate that falls to 0."""
    w, m, v = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and, last, intercept of a logistic regression with an L2 penalty on weights."""
    n = max(1, len(y))
    x = x.astype(np.float32)
    xt = np.ascontiguousarray(x.T)

    def gradient(w: np.ndarray) -> np.ndarray:
        miss = sigmoid(x @ w[:-1].astype(np.float32) + w[-1]) - y
        return np.append(xt @ miss.astype(np.float32) / n + penalty * w[:-1] / n, miss.sum() / n)

    return descend(gradient, np.zeros(x.shape[1] + 1))


def score_rows(chosen: np.ndarray, weights: np.ndarray, finish: Callable[[np.ndarray], dict[str, np.ndarray]]):
    """A mapInArrow function: all columns, and what `finish` makes of texts x models sums of weights (features by models) of the column text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("linear")
        place = np.full(FEATURES, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        for batch in parts:
            for part, texts in batches(batch):
                rows, found = features(texts)
                at = place[found]
                rows, at = rows[at >= 0], at[at >= 0]
                sums = np.stack([np.bincount(rows, weights=w[at], minlength=len(texts)) for w in weights.T], axis=1)
                for name, values in finish(sums).items():
                    part = part.append_column(name, pa.array(values))
                yield part

    return run
