"""Which of many folded texts hold a term with errors: windows of a portion of texts are compared side by side."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

#: Letters that stylised print confuses, besides those equal after folding.
ALIKE = {"a": "a4@w", "b": "b8", "e": "e3", "g": "g69", "i": "i1l|!", "o": "o0", "s": "s5$", "t": "t7", "u": "uv", "v": "vu", "w": "wa", "y": "yv", "z": "z2"}
SLACK = ((6, 1, 1), (9, 2, 2))  # up to this length: edits allowed, slack of a window's length
PORTION = 1 << 20  # signs compared side by side
END = "\n"  # stands between texts; folded texts hold letters and digits alone


def alike(a: str, b: str) -> bool:
    return a == b or a in ALIKE.get(b, b) or b in ALIKE.get(a, a)


@functools.lru_cache(maxsize=256)
class Letters:
    """The signs that are alike to letters of a term, in classes: 0 is any other sign, 1 the end of a text."""

    def __init__(self, term: str):
        own: dict[tuple[bool, ...], int] = {}
        self.of = np.zeros(0x110000, np.uint8)
        for c in sorted({*term, *ALIKE, *"".join(ALIKE.values())}):
            like = tuple(alike(c, t) for t in term)
            if any(like):
                self.of[ord(c)] = own.setdefault(like, len(own) + 2)
        self.of[ord(END)] = 1
        self.alike = np.array([(False,) * len(term), (False,) * len(term), *own], bool).T  # by letter of the term and class
        self.next = np.full((len(term) + 1, len(own) + 2), len(term) + 1, np.int16)  # the letter reached from a letter, by class; len + 1 is none
        for j in range(len(term) - 1, -1, -1):
            self.next[j] = np.where(self.alike[j], j + 1, self.next[j + 1])

    @staticmethod
    def marked(raw: bytes, classes: np.ndarray) -> np.ndarray:
        """Where signs are of the classes that are true."""
        return np.frombuffer(raw.translate(bytes(classes.tolist()) + bytes(256 - len(classes))), bool)


def portions(texts: Iterable[tuple[int, str]], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Texts, each with its row, joined to portions: rows, ends, signs. A text longer than a portion is cut into stretches that overlap by `reach`."""
    rows, parts, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, str]:
        return np.array(rows), np.cumsum([len(p) + 1 for p in parts]), END.join(parts)

    for row, text in texts:
        for start in range(0, len(text), PORTION):
            part = text[start : start + PORTION + reach]
            if parts and size + len(part) > PORTION:
                yield out()
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield out()


def near_starts(raw: bytes, letters: Letters, n: int, most: int, lengths: range) -> np.ndarray:
    """Places where a window of one of the lengths begins with a letter like the term's first and is within `most` edits of its first n letters.

    Of n letters in most + 1 pieces at least one is whole in such a window, at most `most` places off; only windows with one are compared.
    """
    codes = np.frombuffer(raw, np.uint8)
    size = len(codes)
    same = [letters.marked(raw, letters.alike[j]) for j in range(n)]
    near = np.zeros(size, bool)
    ends = [n * k // (most + 1) for k in range(most + 2)]
    for a, b in zip(ends, ends[1:], strict=False):
        whole = same[a][: size - (b - a - 1)].copy()
        for k in range(1, b - a):
            whole &= same[a + k][k : size - (b - a - 1) + k]
        for off in range(-a - most, -a + most + 1):  # a piece at p speaks for a window from p + off
            if off <= 0:
                near[: max(0, len(whole) + off)] |= whole[-off:]
            else:
                near[off : off + len(whole)] |= whole[: size - off]
    at = np.flatnonzero(near & same[0])
    kind = np.int8 if n < 100 else np.int16
    steps = np.arange(n + 1, dtype=kind)[:, None]
    other = (~letters.alike[:n]).astype(kind)
    row = np.repeat(steps, len(at), axis=1)
    found = []
    for i in range(1, lengths[-1] + 1):
        c = codes[at + (i - 1)]
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + other[:, c], row[1:] + kind(1), out=new[1:])
        row = np.minimum.accumulate(new - steps, axis=0) + steps
        goes_on = (row.min(axis=0) <= most) & (c != 1)
        if i in lengths:
            hit = (row[-1] <= most) & (c != 1)
            found.append(at[hit])
            goes_on &= ~hit
        at, row = at[goes_on], row[:, goes_on]
        if not len(at):
            break
    return np.concatenate(found) if found else at[:0]


def shortened_starts(raw: bytes, letters: Letters, n: int) -> np.ndarray:
    """Places where the term begins with letters missing: at most 3 and 35 % of it, 5 left."""
    codes = np.frombuffer(raw, np.uint8)
    least = max(5, n - 3, int(n * 0.65))
    at = np.flatnonzero(letters.marked(raw, letters.alike[: n - least + 1].any(axis=0)))
    reached = letters.next[0][codes[at]]
    for k in range(2, least + 1):  # the earliest letter that goes on leaves most room for the rest
        reached = letters.next[reached, codes[at + (k - 1)]]
        goes_on = reached <= n - (least - k)
        at, reached = at[goes_on], reached[goes_on]
    return at


def starts_of(signs: str, term: str, mirrored: bool = False) -> np.ndarray:
    """Places in texts joined by END where one of five letters or more stands within an edit distance over windows, or with letters missing, either way round. `mirrored` texts read the same both ways."""
    n = len(term)
    edits, slack = next(((e, s) for top, e, s in SLACK if n <= top), (3, 2))
    targets = [(n, edits)] + ([(n - 1, min(1, edits))] if n >= 7 else [])
    codes = np.frombuffer((signs + END * (n + slack + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = Letters(term)
    raw = letters.of[codes].tobytes()
    starts = [near_starts(raw, letters, m, most, range(max(4, m - slack), m + slack + 1)) for m, most in targets]
    if n >= 7:
        starts.append(shortened_starts(raw, letters, n))
        if not mirrored:
            back = Letters(term[::-1])
            starts.append(shortened_starts(back.of[codes].tobytes(), back, n))
    return np.concatenate(starts)


def hold_nearly(texts: Iterable[tuple[int, str]], term: str, rows: int, mirrored: bool = False) -> np.ndarray:
    """Of each row's folded texts, whether one holds the folded term: up to four letters as they are or reversed, longer ones with errors."""
    held = np.zeros(rows, bool)
    if len(term) < 5:
        for row, text in texts:
            held[row] |= term in text or term[::-1] in text
        return held
    for own, ends, signs in portions(texts, len(term) + 2):
        held[own[np.searchsorted(ends, starts_of(signs, term, mirrored), "right")]] = True
    return held


def words_nearly(words: list[str], term: str) -> list[int]:
    """Places of short folded words that hold the folded term."""
    if len(term) < 5:
        return [k for k, w in enumerate(words) if term in w or term[::-1] in w]
    signs = END.join(words)
    ends = np.flatnonzero(np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(END))
    return np.unique(np.searchsorted(ends, starts_of(signs, term), "right")).tolist()
