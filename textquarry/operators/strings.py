"""Which of very many strings stand in texts: one pass over the texts, whatever the number of strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import _BASE, _BYTES, LONGEST, U
from ..sources.shared import written

BLOCK = 1 << 18  # strings of a block
BLOCK_BYTES = 16 << 20
PIECE = 1 << 18
PAIRS = 1 << 20
CELLS = 1 << 22
WEIGHT = 4 << 20  # bytes of texts passed over at once
PRUNED = (3, 4, 6, 9)  # lengths after which only places are followed where a longer string may stand


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings one after another, and where each begins and the last ends; a null is empty."""
    bare = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bare = bare.cast(pa.large_binary()).fill_null(b"")
    _, starts, data = bare.buffers()
    at = np.frombuffer(starts, np.int64)[bare.offset : bare.offset + len(bare) + 1] if len(bare) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), at


def _table(hashes: np.ndarray, room: int) -> tuple[np.ndarray, np.uint64]:
    """Whether one of the hashes begins so, for every beginning of some bits: `room` of these a hash at least."""
    bits = max(16, (room * len(hashes)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[hashes >> U(64 - bits)] = True
    return table, U(64 - bits)


class Strings:
    """A block of strings, none of them empty: those of one or two bytes by these, others by the rolling hashes of their first signs.

    Many texts are passed over at once, window by window of growing length. A
    window goes on only where its hash is that of the beginning of a string;
    where it is the key of one, the bytes are compared.
    """

    def __init__(self, strings: pa.Array | pa.ChunkedArray) -> None:
        self.data, self.at = _flat(strings)
        self.length = np.diff(self.at)
        signs = np.minimum(self.length, LONGEST)
        self.longest = int(signs.max(initial=0))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in (1, 2):
            own = np.flatnonzero(signs == k)
            if len(own):
                turns = np.zeros(1 << (8 * k), np.int64)
                turns[self._code(own, k)] = np.arange(1, len(own) + 1)
                self.short[k] = turns, np.concatenate([[-1], own])
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[self._code(np.flatnonzero(signs > 2), 2)] = True
        hashes = np.zeros(len(signs), U)
        self.ends: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        begun = [np.zeros(0, U)]
        for k in range(1, self.longest + 1):
            live = np.flatnonzero(signs >= k)
            hashes[live] = hashes[live] * U(_BASE) + _BYTES[self.data[self.at[live] + k - 1]]
            done = live[signs[live] == k]
            if k > 2 and len(done):
                order = done[np.argsort(hashes[done])]
                self.ends[k] = *np.unique(hashes[order], return_index=True, return_counts=True), order
            if k in PRUNED:
                begun.append(hashes[live[signs[live] > k]])
        self.keys, self.begins = _table(hashes[signs > 2], 32), _table(np.unique(np.concatenate(begun)), 8)

    def _code(self, own: np.ndarray, k: int) -> np.ndarray:
        """The first one or two bytes of strings as a number."""
        first = self.data[self.at[own]].astype(np.int64)
        return first if k == 1 else first << 8 | self.data[self.at[own] + 1]

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row of a text and number of a string that stands in it, each pair once, in order."""
        data, at = _flat(texts)
        found = [np.zeros(0, np.int64)]
        for start in range(int(at[0]), int(at[-1]), PIECE):
            stop = min(start + PIECE + LONGEST - 1, int(at[-1]))
            part = data[start:stop]
            twos = part[:-1].astype(np.uint16) << 8 | part[1:]
            found.extend(self._short(part, twos[:PIECE], at, start))
            if self.longest > 2:
                found.extend(self._long(data, part, twos[:PIECE], at, start))
            if sum(map(len, found)) > PAIRS:
                found = [np.unique(np.concatenate(found))]
        pairs = np.unique(np.concatenate(found))
        return np.divmod(pairs, max(1, len(self.length)))

    def _short(self, part: np.ndarray, twos: np.ndarray, at: np.ndarray, start: int) -> Iterator[np.ndarray]:
        """Pairs, as numbers, of the strings of one or two bytes that begin in the piece."""
        n = min(PIECE, len(part))
        first, last = (int(k) - 1 for k in np.searchsorted(at, [start, start + n - 1], "right"))
        ends = np.minimum(at[first + 1 : last + 2] - start, n)
        rows = np.repeat(np.arange(last - first + 1), np.diff(ends, prepend=0))
        for k, (turns, own) in self.short.items():
            turn = turns[part[:n] if k == 1 else twos]
            if k == 2:
                final = at[first + 1 : last + 2] - start - 1
                turn[final[final < len(turn)]] = 0
            cells = rows[: len(turn)] * len(own) + turn
            if (last - first + 1) * len(own) <= CELLS:
                held = np.zeros((last - first + 1) * len(own), bool)
                held[cells] = True
                cells = np.flatnonzero(held)
            else:
                cells = np.unique(cells[turn > 0])
            row, turn = np.divmod(cells, len(own))
            yield ((first + row) * len(self.length) + own[turn])[turn > 0]

    def _long(self, data: np.ndarray, part: np.ndarray, twos: np.ndarray, at: np.ndarray, start: int) -> Iterator[np.ndarray]:
        """Pairs, as numbers, of the longer strings that begin in the piece."""
        values = _BYTES[part]
        places = np.flatnonzero(self.pairs[twos])
        hashes = values[places] * U(_BASE) + values[places + 1]
        for k in range(3, self.longest + 1):
            room = np.searchsorted(places, len(part) - k, "right")
            places, hashes = places[:room], hashes[:room] * U(_BASE)
            hashes += values[places + (k - 1)]
            if k in self.ends:
                table, shift = self.keys
                hits = np.flatnonzero(table[hashes >> shift])
                for pairs in self._same(data, at, start + places[hits], hashes[hits], k):
                    yield np.unique(pairs)
            if k in PRUNED:
                table, shift = self.begins
                on = np.flatnonzero(table[hashes >> shift])
                places, hashes = places[on], hashes[on]

    def _same(self, data: np.ndarray, at: np.ndarray, places: np.ndarray, hashes: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Pairs, as numbers, of places and strings whose key of k signs has the place's hash: those that are the same to the string's end and lie within a text."""
        keys, low, n, order = self.ends[k]
        turn = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        same = keys[turn] == hashes
        places, low, n = places[same], low[turn[same]], n[turn[same]]
        sums = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + PAIRS, "right")))
            many = n[first:last]
            turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place, own = np.repeat(places[first:last], many), order[np.repeat(low[first:last], many) + turn]
            row = np.searchsorted(at, place, "right") - 1
            within = place + self.length[own] <= at[row + 1]
            place, own, row = place[within], own[within], row[within]
            for j in range(k):
                same = data[place + j] == self.data[self.at[own] + j]
                if not same.all():
                    place, own, row = place[same], own[same], row[same]
            pairs = row * len(self.length) + own
            yield pairs[self._to_end(data, place, own)] if k == LONGEST else pairs
            first = last

    def _to_end(self, data: np.ndarray, places: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of the places hold their string beyond its first LONGEST signs too."""
        text, strings = memoryview(data), memoryview(self.data)
        return np.fromiter((text[p + LONGEST : p + n] == strings[a + LONGEST : a + n] for p, a, n in zip(places.tolist(), self.at[own].tolist(), self.length[own].tolist(), strict=True)), bool, len(places))


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in portions of WEIGHT bytes, or of one text that is longer."""
    at, first = _flat(texts)[1], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + WEIGHT, "right")) - 1)
        yield texts.slice(first, last - first)
        first = last


def numbered(strings: DataFrame) -> DataFrame:
    """string, place: the distinct strings (the only column) that are not empty, each with a number, written once."""
    own = strings.toDF("string").where("string <> ''").distinct()
    return written(own.select("string", F.monotonically_increasing_id().alias("place")), "strings")


def blocks_of(strings: DataFrame, block: int) -> int:
    """How many blocks of about `block` strings, and of BLOCK_BYTES, the column `string` takes."""
    facts = strings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("bytes")).first()
    return max(-(-facts["n"] // block), -(-facts["bytes"] // BLOCK_BYTES))


def places_held(strings: DataFrame) -> Callable[[Column], Column]:
    """A function of texts: the array of the places of those strings (string, place: one block) that stand in the text; of null none. All of many texts is worked out at once, and exactly, where the texts are, so that nothing is shuffled."""
    own = strings.select("string", "place").toArrow()
    sent = strings.sparkSession.sparkContext.broadcast((own.column(0).combine_chunks(), own.column(1).to_numpy()))

    def held(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bare, places = sent.value
        known = Strings(bare)
        for texts in parts:
            lists = [pa.array([], pa.list_(pa.int64()))]
            for part in _portions(texts):
                row, own = known.held(part)
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.array(places[own], pa.int64())))
            yield pa.concat_arrays(lists)

    return F.arrow_udf(held, "array<bigint>").asNondeterministic()  # so that no filter on what was found works it out again


def strings_held(texts: DataFrame, strings: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, string, each pair once: which strings (the only column of `strings`) stand in which texts (id as a string, text).

    Strings go to the texts in blocks of about `block`; more take further passes
    over the texts. Null and empty strings stand in nothing.
    """
    own = numbered(strings)
    texts = texts.toDF("id", "text").where("id IS NOT NULL AND text IS NOT NULL")
    blocks = blocks_of(own, block)
    out = None
    for k in range(blocks):
        part = own.where(F.pmod(F.xxhash64("string"), F.lit(blocks)) == k)
        found = texts.select("id", places_held(part)(F.col("text")).alias("found")).select("id", F.explode("found").alias("place")).join(part, "place").select("id", "string")
        out = found if out is None else out.union(found)
    return texts.select("id", F.col("text").alias("string")).limit(0) if out is None else out.distinct()
