"""Vectorised word and shingle hashes of UTF-8 texts.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, taken from running sums, so that a
batch of texts costs a few array operations and no work per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARKS = _SPACE.copy()
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a xor-shift-multiply finisher)."""
    x = x.astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER + 1).astype(U) * U(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]
_memory: list[Callable[[], None]] = []
_owner: list[str] = []


def remembers(clear: Callable[[], None]) -> None:
    """Registers how to clear what a worker remembers between tasks."""
    _memory.append(clear)


def _forget_powers() -> None:
    _powers[:] = [np.empty(0, U), np.empty(0, U)]


remembers(_forget_powers)


def claim(owner: str) -> None:
    """To be called first in a task: a worker that served another operator before forgets what it remembered for it."""
    if _owner != [owner]:
        _owner[:] = [owner]
        for clear in _memory:
            clear()
        pa.default_memory_pool().release_unused()


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, U(base))
            row[0] = U(1)
            _powers[i] = np.multiply.accumulate(row)
    return _powers


def _hash_buffer(buffer: bytes, marks: bool, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a buffer that ends in white space, and a row of hashes: of the words, then of each word's first bytes for each of `prefixes`."""
    data = np.frombuffer(buffer, np.uint8)
    space = (_MARKS if marks else _SPACE)[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty((1 + len(prefixes), 0), U)
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    rows = []
    for k in (0, *prefixes):
        stops = np.minimum(starts + k, ends) if k else ends
        raw = (total[stops] - total[starts]) * inverse[starts]
        rows.append(mix(raw + (stops - starts).astype(U) * U(0xA0761D6478BD642F) + U(k)))
    return starts, np.stack(rows)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [p for p in (text.find(c, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def hash_words(texts: list[bytes], marks: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of `texts` in order, and the number of words of each text. With `marks`, ASCII punctuation separates words too; with `prefixes`, rows of hashes of words and of their first bytes."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            starts, found = _hash_buffer(b"\n".join(group) + b"\n", marks, prefixes)
            ends = np.cumsum([len(x) + 1 for x in group])
            np.add.at(counts, np.asarray(owners), np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(group)))
            hashes.append(found)
            group.clear()
            owners.clear()
            size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text) if len(text) > PIECE else (text,):
            if size + len(piece) > PIECE:
                flush()
            group.append(piece)
            owners.append(i)
            size += len(piece) + 1
    flush()
    every = np.concatenate(hashes, axis=1) if hashes else np.empty((1 + len(prefixes), 0), U)
    return (every if prefixes else every[0]), counts


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words of one text or of texts in a row (those that cross texts are the caller's to drop)."""
    if len(words) < n:
        return np.empty(0, U)
    out = np.full(len(words) - n + 1, U(n * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    for k in range(n):
        out = out * U(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes; of fewer words, all words as one; none for no words."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    every = runs(words, n)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            yield np.unique(every[end - count : end - n + 1])
        elif count:
            yield runs(words[end - count : end], count)
        else:
            yield np.empty(0, U)


def batches(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about `most` bytes of text each, and their texts as UTF-8 (null: empty)."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    at, size = 0, 0
    part: list[bytes] = []
    for i in range(len(column)):
        value = column[i].as_py() or b""
        if part and size + len(value) > most:
            yield batch.slice(at, i - at), part
            at, size, part = i, 0, []
        part.append(value)
        size += len(value)
    if part:
        yield batch.slice(at), part


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs, the bits unchanged."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned hashes as one Arrow column of lists of longs."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(longs(flat)))
