"""Rolling hashes of the windows of a text, to find many strings in one pass.

A string is keyed by its first signs, up to 16, so that a text has windows of 16
lengths at most, however many strings there are and however long they are; the
hash of a window grows out of that of the window one sign shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
LONGEST = 16
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTES = mix(np.arange(256) + 1)


def key_length(n: int) -> int:
    """How many first signs key a string of n signs."""
    return min(LONGEST, n)


def windows(codes: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each piece of a text (bytes or code points) and each length: the length, where the piece starts, and the hashes of the windows that begin in it. The array of hashes is good until the next one is asked for."""
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + LONGEST - 1]
        values = _BYTES[part] if part.dtype == np.uint8 else mix(part.astype(U) + U(1))
        found = np.zeros(min(PIECE, len(codes) - at), U)
        for k in range(max(lengths, default=0)):
            found = found[: len(values) - k]
            found *= U(_BASE)
            found += values[k : k + len(found)]
            if k + 1 in lengths and len(found):
                yield k + 1, at, found


def key_of(codes: np.ndarray) -> int:
    """The key of a string that is not empty."""
    length = key_length(len(codes))
    return int(next(windows(codes[:length], {length}))[2][0])


class KeyFilter:
    """A Bloom filter of keys: 32 bits and four places for each, by the leading bits of its products; of other windows it holds one in some thousands."""

    PLACES = (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(18, (32 * len(keys)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        for odd in self.PLACES:
            self.table[keys * U(odd) >> U(64 - self.bits)] = True

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Where keys stand that the filter holds."""
        hits = np.flatnonzero(self.table[keys >> U(64 - self.bits)])
        for odd in self.PLACES[1:]:
            if len(hits):
                hits = hits[self.table[keys[hits] * U(odd) >> U(64 - self.bits)]]
        return hits
