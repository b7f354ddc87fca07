"""Spelling variants: words one edit apart, by a bit-sliced position index.

A block of the vocabulary is indexed by position and letter: a bitset over the
block's words for each letter that stands at a position. A word is compared
with the whole block at once, letter by letter: one bitset holds the words that
agree so far, three more those with one letter replaced, one more or one less,
which read the index at the same, the next or the last position. Words in order
share the states of their common beginnings.

Two words of at least six letters that are one edit apart agree in their first
or in their last three letters, so the vocabulary is dealt by either, and a
pair counts where it agrees first. What many words begin or end with is cut
into blocks by hash, and every block of words meets every block of the index.
No pairs leave a task: a word's count and best neighbour do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut
from ._words import U, claim

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS, LEAST, RATIO = 6, 5, 5
BLOCK = 1 << 16  # letters of the words of a block
SHARED_STATES = 32  # letters of which a task keeps the states
HELD = 1 << 26  # bytes of bitsets that a task holds


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, slip: int | None = None) -> DataFrame:
    """word, n of the words of at least `letters` letters that occur at least `least` times; a word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    With `slip`, a run loses its letter h % length if `slip` divides h, the CRC-32
    of `<doc_id>:<run>` (a null doc_id: nothing before the colon): misspellings
    made by rule, to be found.
    """
    run = f"[{RUN}]{{{letters},}}"
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(run), F.lit(0))).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("word"))
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")))
        at = F.pmod("h", F.char_length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        rows = rows.select(F.when(F.pmod("h", F.lit(slip)) == 0, less).otherwise(F.col("word")).alias("word"))
    return rows.where(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets over words (of letters up to U+00FF, as Latin-1 bytes) for each position and letter, made when first asked for."""

    def __init__(self, words: list[bytes]) -> None:
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer(b"".join(words), np.uint8)
        self.width = -(-len(words) // 64)
        self.none = np.zeros(self.width, U)
        self.every = self._bits(np.ones(len(words), bool))
        self.at: dict[int, dict[int, np.ndarray]] = {}
        self.held = 0  # bytes of them, about
        self.long: dict[int, np.ndarray] = {}

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(8 * self.width, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[: len(packed)] = packed
        return out.view(U)

    def holding(self, position: int, letter: int) -> np.ndarray:
        """The words with this letter at this position (none before the first)."""
        if position < 0:
            return self.none
        found = self.at.get(position)
        if found is None:
            if self.held > HELD:
                self.at.clear()
                self.held = 0
            here = self.lengths > position
            column = np.where(here, self.codes[np.where(here, self.starts + position, 0)], 0)
            found = self.at[position] = {int(c): self._bits(column == c) for c in np.unique(column[here])}
            self.held += 8 * self.width * len(found) + 512
        return found.get(letter, self.none)

    def of_length(self, n: int) -> np.ndarray:
        if n not in self.long:
            self.long[n] = self._bits(self.lengths == n)
        return self.long[n]

    def neighbours(self, words: list[bytes], head: int, agree: bool):
        """For each of the sorted words its place and the bitset of the words one edit from it that agree (or do not) in the first `head` letters."""
        states = [(self.every, self.none, self.none, self.none, self.none)]
        before = b""
        for place, word in enumerate(words):
            same = 0
            most = min(len(word), len(before), len(states) - 1)
            while same < most and word[same] == before[same]:
                same += 1
            del states[same + 1 :]
            whole, replaced, more, less, begun = states[same]
            for j in range(same, len(word)):
                c = word[j]
                here = self.holding(j, c)
                replaced = replaced & here | whole & ~here
                more = (more | whole) & self.holding(j + 1, c)
                less = less & self.holding(j - 1, c) | whole
                whole = whole & here
                if j + 1 == head:
                    begun = whole
                    if agree:  # then the edit comes later
                        replaced = more = less = self.none
                if j < SHARED_STATES:
                    states.append((whole, replaced, more, less, begun))
                if j % 4 == 3 and not (whole | replaced | more | less).any():
                    break
            else:
                n = len(word)
                near = replaced & self.of_length(n) | (more | whole) & self.of_length(n + 1) | less & self.of_length(n - 1)
                near = near & begun if agree else near & ~begun
                if near.any():
                    yield place, near
            before = word


NEAR = pa.schema({"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()})


def _near(head: int):
    def run(table: pa.Table) -> pa.Table:
        """Words of a block, and how many of another are near, and which of these is the most frequent."""
        claim("spelling")
        words, n, role = table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("role").to_pylist()
        # the most frequent first, ties in code point order: the first bit of a set is the best
        index = sorted((k for k, r in enumerate(role) if r != 1), key=lambda k: (-n[k], words[k]))
        asked = sorted((k for k, r in enumerate(role) if r != 0), key=lambda k: words[k])
        rows: list[tuple] = []
        if index and asked:
            held = PositionIndex([words[k].encode("latin-1") for k in index])
            for place, near in held.neighbours([words[k].encode("latin-1") for k in asked], head, table.column("side")[0].as_py() == 0):
                lane = int(np.flatnonzero(near)[0])
                bits = int(near[lane])
                best = index[64 * lane + (bits & -bits).bit_length() - 1]
                rows.append((words[asked[place]], int(np.bitwise_count(near).sum()), n[best], words[best]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, NEAR, strict=True)], schema=NEAR)

    return run


def near_words(words: DataFrame, letters: int = LETTERS, block: int = BLOCK) -> DataFrame:
    """Of words (word, n; distinct, of at least `letters` letters): word, n_near, best_n, best, for those with a word one edit away; the best is the most frequent one, ties the first in code point order."""
    head = letters // 2
    total = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    buckets = max(1, -(-2 * total // block))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, head).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -head, head).alias("key")))
    keyed = words.select("word", "n", F.explode(sides).alias("at")).select("word", "n", "at.side", F.pmod(F.xxhash64("at.side", "at.key"), F.lit(buckets)).alias("bucket"))
    sizes = keyed.groupBy("side", "bucket").agg(F.ceil(F.sum(F.char_length("word")) / block).cast("int").alias("blocks"))
    keyed = keyed.join(broadcast_if(sizes), ["side", "bucket"]).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "word"), F.col("blocks")).cast("int"))

    def meeting(other):
        role = lambda i, j, r: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(r).alias("role"))
        own = F.col("own")
        return F.when(other == own, F.array(role(own, own, 2))).otherwise(F.array(role(own, other, 0), role(other, own, 1)))

    met = keyed.withColumn("met", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meeting))))
    met = met.select("side", "bucket", "met.i", "met.j", "met.role", "word", "n")
    found = met.groupBy("side", "bucket", "i", "j").applyInArrow(_near(head), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), "best.best")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, ratio: int = RATIO, slip: int | None = None, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of `docs` (see `word_counts`).

    Two words are near if one inserted, deleted or replaced letter makes them
    equal. A word's form is its most frequent near word (ties: the first in code
    point order) if that occurs at least `ratio` times as often, else null; its
    root is where forms lead to, itself without one. Null and empty texts have
    no words; rows alike count each; an empty table gives an empty result; other
    columns are ignored. A word may have any length.
    """
    if ratio < 2 or letters < 2:
        raise ValueError("ratio and letters must be 2 or more")
    words = cut(word_counts(docs, letters, least, slip), "spelling-words")
    near = near_words(words, letters, block)
    formed = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    told = cut(told, "spelling-forms")
    # each form is `ratio` times as frequent, so few lead to a root; jumps double
    most = told.agg(F.max("n")).first()[0] or least
    jumps = cut(told.where("form IS NOT NULL").select("word", F.col("form").alias("top")), "spelling-roots")
    for _ in range(math.ceil(math.log(most / least, ratio) if most > least else 0).bit_length()):
        further = jumps.select(F.col("word").alias("top"), F.col("top").alias("next"))
        jumps = cut(jumps.join(further, "top", "left").select("word", F.coalesce("next", "top").alias("top")), "spelling-roots")
    return told.join(jumps, "word", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
