"""Lossless WebP: an encoder and decoder of images, both working on many images at once.

Pixels are unsigned 32-bit ARGB numbers. The decoder reads any lossless stream:
prefix codes, back-references, the colour cache, groups of codes, and the
predictor, cross-colour, subtract-green and palette transforms. Plain images,
whose streams have one group of codes and literals alone, are decoded side by
side: step by step one symbol of every image, as array operations.
"""

from __future__ import annotations

import heapq

import numpy as np

CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed values: order of code length codes
#: Fixed values: (x, y) of the 120 short distances of back-references.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LONGEST = 15
HEAD = 5  # bytes before transforms and pixels
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code, at most `longest`: counts are flattened until they fit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), i, (int(s),)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys(used.tolist(), 0)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(depth.values()) <= longest:
            out[list(depth)] = list(depth.values())
            return out
        floor = floor * 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol as it stands in the stream, first bit lowest."""
    codes, code = np.zeros(len(lengths), np.int64), 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    before = 0
    for s in order.tolist():
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = int(format(code, f"0{before}b")[::-1], 2)
        code += 1
    return codes


def lookup(lengths: np.ndarray) -> np.ndarray:
    """Table over the next LONGEST bits of symbol * 16 + length; a lone symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.full(1 << LONGEST, int(used[0]) * 16, np.int32)
    if not len(used) or np.sum(2.0 ** -lengths[used]) != 1:
        raise ValueError("incomplete prefix code")
    table = np.zeros(1 << LONGEST, np.int32)
    codes = canonical(lengths)
    for s in used.tolist():
        table[codes[s] :: 1 << int(lengths[s])] = s * 16 + int(lengths[s])
    return table


# ------------------------------------------------------------------- encoding


class Bits:
    """Bits in stream order, lowest first."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of up to 32 bits each, one after another, lowest bit first."""
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    words = np.zeros(total // 32 + 3, np.uint64)
    low = values.astype(np.uint64) << (at & 31).astype(np.uint64)
    np.bitwise_or.at(words, at >> 5, low & np.uint64(0xFFFFFFFF))
    np.bitwise_or.at(words, (at >> 5) + 1, low >> np.uint64(32))
    return words.astype("<u4").tobytes()[: (total + 7) // 8]


def put_code(bits: Bits, lengths: np.ndarray) -> None:
    """The description of a prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        symbol = int(used[0]) if len(used) else 0
        bits.put(1, 1)  # simple
        bits.put(0, 1)  # one symbol
        bits.put(1, 1)
        bits.put(symbol, 8)
        return
    bits.put(0, 1)
    runs: list[tuple[int, int, int]] = []  # symbol, extra bits' value, their number
    i = 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, value = j - i, int(lengths[i])
        if value == 0:
            while n:
                take = min(n, 138)
                runs.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3) if take >= 3 else (0, 0, 0))
                n -= take if take >= 3 else 1
        else:
            runs.append((value, 0, 0))
            n -= 1
            while n:
                take = min(n, 6)
                runs.append((16, take - 3, 2) if take >= 3 else (value, 0, 0))
                n -= take if take >= 3 else 1
        i = j
    inner = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    count = max(4, 1 + max(k for k, s in enumerate(CODE_ORDER) if inner[s]))
    bits.put(count - 4, 4)
    for s in CODE_ORDER[:count]:
        bits.put(int(inner[s]), 3)
    bits.put(0, 1)  # lengths of the whole alphabet follow
    codes, lone = canonical(inner), np.count_nonzero(inner) == 1
    for symbol, extra, size in runs:
        bits.put(int(codes[symbol]), 0 if lone else int(inner[symbol]))
        if size:
            bits.put(extra, size)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' value and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = value >> (top - 1) & 1
    return 2 * top + second, value & ((1 << (top - 1)) - 1), top - 1


def cache_slot(argb: int, bits: int) -> int:
    return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - bits)


def put_pixels(bits: Bits, pixels: np.ndarray, width: int, cache_bits: int, references: bool, main: bool) -> None:
    """Entropy-coded image with one group of codes; with `references`, greedy matches of earlier runs."""
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)  # one group
    values, steps = pixels.tolist(), []
    cache: list[int] = [0] * (1 << cache_bits) if cache_bits else []
    seen: dict[tuple, int] = {}
    i = 0
    while i < len(values):
        length = 0
        if references and i + 3 <= len(values):
            start = seen.get(tuple(values[i : i + 3]))
            if start is not None:
                while length < 4096 and i + length < len(values) and values[start + length] == values[i + length]:
                    length += 1
        if length >= 3:
            steps.append(("copy", length, i - start))
        else:
            length = 1
            v = values[i]
            hit = cache_bits and cache[cache_slot(v, cache_bits)] == v and v
            steps.append(("cache", cache_slot(v, cache_bits), 0) if hit else ("literal", v, 0))
        for k in range(i, i + length):
            if cache_bits:
                cache[cache_slot(values[k], cache_bits)] = values[k]
            if references and k + 3 <= len(values):
                seen[tuple(values[k : k + 3])] = k
        i += length
    counts = [np.zeros(280 + (1 << cache_bits if cache_bits else 0), np.int64), *(np.zeros(256, np.int64) for _ in range(3)), np.zeros(40, np.int64)]
    coded = []
    for kind, a, b in steps:
        if kind == "literal":
            coded.append([(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)])
        elif kind == "cache":
            coded.append([(0, 280 + a, 0, 0)])
        else:
            n, d = prefix_of(a), prefix_of(b + 120)
            coded.append([(0, 256 + n[0], n[1], n[2]), (4, d[0], d[1], d[2])])
        for c, s, _, _ in coded[-1]:
            counts[c][s] += 1
    lengths = [code_lengths(c) for c in counts]
    for own in lengths:
        put_code(bits, own)
    codes = [canonical(own) for own in lengths]
    lone = [np.count_nonzero(own) <= 1 for own in lengths]
    for step in coded:
        for c, s, extra, size in step:
            bits.put(int(codes[c][s]), 0 if lone[c] else int(lengths[c][s]))
            if size:
                bits.put(extra, size)


def container(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def put_head(bits: Bits, width: int, height: int) -> None:
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        bits.put(value, size)


def split(pixels: np.ndarray) -> np.ndarray:
    """Channels a, r, g, b of ARGB pixels as rows."""
    return np.stack([pixels >> 24, pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255]).astype(np.int64)


def merge(a, r, g, b) -> np.ndarray:
    return ((np.asarray(a, np.int64) & 255) << 24 | (np.asarray(r, np.int64) & 255) << 16 | (np.asarray(g, np.int64) & 255) << 8 | np.asarray(b, np.int64) & 255).astype(np.uint32)


def blocks(width: int, size_bits: int) -> int:
    return (width + (1 << size_bits) - 1) >> size_bits


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False) -> bytes:
    """One image (height x width, ARGB) as a WebP file. transforms, applied in order: ("green",), ("palette",), ("predictor", bits, modes), ("cross", bits, elements); modes and elements one per block."""
    height, width = pixels.shape
    bits = Bits()
    put_head(bits, width, height)
    image = pixels.astype(np.uint32)
    for kind, *rest in transforms:
        bits.put(1, 1)
        if kind == "green":
            bits.put(SUBTRACT_GREEN, 2)
            a, r, g, b = split(image)
            image = merge(a, r - g, g, b - g)
        elif kind == "palette":
            bits.put(PALETTE, 2)
            colours, index = np.unique(image, return_inverse=True)
            index = index.reshape(image.shape)
            bits.put(len(colours) - 1, 8)
            deltas = merge(*np.diff(split(colours), axis=1, prepend=0))
            put_pixels(bits, deltas, len(colours), 0, False, False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            wide = np.zeros((height, blocks(image.shape[1], pack)), np.int64)
            for x in range(image.shape[1]):
                wide[:, x >> pack] |= index[:, x] << (8 >> pack) * (x & (1 << pack) - 1)
            image = merge(255, 0, wide, 0)
        elif kind == "predictor":
            size_bits, modes = rest
            bits.put(PREDICTOR, 2)
            bits.put(size_bits - 2, 3)
            put_pixels(bits, merge(255, 0, modes, 0).ravel(), modes.shape[1], 0, False, False)
            image = predict(image, size_bits, modes, forward=True)
        elif kind == "cross":
            size_bits, elements = rest
            bits.put(CROSS_COLOUR, 2)
            bits.put(size_bits - 2, 3)
            put_pixels(bits, elements.ravel(), elements.shape[1], 0, False, False)
            image = cross(image, size_bits, elements, forward=True)
    bits.put(0, 1)
    put_pixels(bits, image.ravel(), image.shape[1], cache_bits, references, True)
    return container(pack_bits(np.array(bits.values, np.int64), np.array(bits.sizes, np.int64)))


def encode_plain(images: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    """Images as literals under one given code of all four channels (a length for every byte): header and code are the same bits for all."""
    codes = canonical(lengths)
    frame = Bits()
    for value, size in ((0, 1), (0, 1), (0, 1)):  # no transform, no cache, one group
        frame.put(value, size)
    put_code(frame, np.concatenate([lengths, np.zeros(24, np.int64)]))
    for _ in range(3):
        put_code(frame, lengths)
    put_code(frame, np.zeros(40, np.int64))
    out = []
    for image in images:
        head = Bits()
        put_head(head, image.shape[1], image.shape[0])
        flat = image.ravel()
        symbols = np.stack([flat >> 8 & 255, flat >> 16 & 255, flat & 255, flat >> 24], axis=1).ravel()
        values = np.concatenate([head.values, frame.values, codes[symbols]])
        sizes = np.concatenate([head.sizes, frame.sizes, lengths[symbols]])
        out.append(container(pack_bits(values, sizes)))
    return out


def entropy(images: np.ndarray) -> float:
    """Bits of an image's four channels under codes of their own, without the codes."""
    bits = 0.0
    for shift in (0, 8, 16, 24):
        counts = np.bincount((images >> np.uint32(shift) & np.uint32(255)).ravel(), minlength=1)
        counts = counts[counts > 0]
        bits += float((counts * (np.log2(counts.sum()) - np.log2(counts))).sum())
    return bits


CODES = 2600  # bits that an image's own codes take, about
MOST_COLOURS, FEW, REPEATED, POOR = 256, 0.375, 0.3, 6.5
SIZE_BITS = 5


def choose(image: np.ndarray, plain: np.ndarray) -> tuple[tuple, int, bool] | None:
    """Transforms, bits of the colour cache and whether to use references, by what the image holds; None if its literals under the given code (lengths of bytes) are the least.

    Few colours make a palette (a colour takes 32 bits, an index 8 at most). An
    image whose pixels recur takes references and the colour cache. Else the
    transforms are weighed by the entropy of what they leave, where the given
    code takes more than POOR bits a sample.
    """
    pixels = image.size
    ordered = np.sort(image, axis=None)
    colours = 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1]))
    if colours <= min(MOST_COLOURS, FEW * pixels):
        return (("palette",),), 0, True
    if colours <= REPEATED * pixels:
        return (), 6, True
    cost = sum(int(plain[(image >> np.uint32(shift) & np.uint32(255)).astype(np.int64)].sum()) for shift in (0, 8, 16, 24))
    if cost <= 4 * POOR * pixels:
        return None
    grid = (blocks(image.shape[0], SIZE_BITS), blocks(image.shape[1], SIZE_BITS))
    best = None
    for mode in (1, 2):
        modes = np.full(grid, mode)
        left = predict(image, SIZE_BITS, modes, forward=True)
        a, r, g, b = split(left)
        # how red and blue follow green, in 32nds, as least squares over signed residuals
        signed_g = signed(g)
        norm = max(1, int((signed_g * signed_g).sum()))
        factors = [int(np.clip(round(32 * float((signed_g * signed(c)).sum()) / norm), -128, 127)) for c in (r, b)]
        elements = np.full(grid, int(merge(255, 0, factors[1] & 255, factors[0] & 255)), np.uint32)
        for transforms, rest in (((("predictor", SIZE_BITS, modes),), left), ((("predictor", SIZE_BITS, modes), ("cross", SIZE_BITS, elements)), cross(left, SIZE_BITS, elements, forward=True))):
            bits = entropy(rest) + CODES
            if bits < cost:
                cost, best = bits, (transforms, 0, True)
    return best


def encode_many(images: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    """Each image as a file, with what `choose` takes for it, or as plain literals under the given code."""
    chosen = [choose(image, lengths) for image in images]
    plain = iter(encode_plain([image for image, how in zip(images, chosen, strict=True) if how is None], lengths))
    return [next(plain) if how is None else encode(image, *how) for image, how in zip(images, chosen, strict=True)]


# ------------------------------------------------------------------- decoding


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = np.frombuffer(data + b"\0" * 8, np.uint8), 0, 8 * len(data)
        self.raw = data + b"\0" * 8

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.raw[k : k + 8], "little") >> (self.at & 7)

    def get(self, size: int) -> int:
        value = self.peek() & ((1 << size) - 1)
        self.at += size
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.peek() & ((1 << LONGEST) - 1)])
        self.at += found & 15
        return found >> 4


def read_lengths(reader: Reader, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if reader.get(1):
        two = reader.get(1)
        lengths[reader.get(8 if reader.get(1) else 1)] = 1
        if two:
            lengths[reader.get(8)] = 1
        return lengths
    inner = np.zeros(19, np.int64)
    for k in range(4 + reader.get(4)):
        inner[CODE_ORDER[k]] = reader.get(3)
    table = lookup(inner)
    left = alphabet if not reader.get(1) else 2 + reader.get(2 + 2 * reader.get(3))
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = reader.symbol(table)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + reader.get(2) if s == 16 else 3 + reader.get(3) if s == 17 else 11 + reader.get(7)
            lengths[at : at + n] = before if s == 16 else 0
            at += n
    return lengths


def read_extra(reader: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    size = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << size) + reader.get(size) + 1


def read_pixels(reader: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = reader.get(4) if reader.get(1) else 0
    group_bits, groups = 0, None
    if main and reader.get(1):
        group_bits = reader.get(3) + 2
        groups = (read_pixels(reader, blocks(width, group_bits), blocks(height, group_bits), False) >> 8 & 0xFFFF).astype(int)
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = [[lookup(read_lengths(reader, a)) for a in alphabets] for _ in range(1 + (int(groups.max()) if groups is not None else 0))]
    out, cache = np.zeros(width * height, np.uint32), [0] * (1 << cache_bits)
    at = kept = 0

    def remember() -> None:
        nonlocal kept
        while cache_bits and kept < at:
            v = int(out[kept])
            cache[cache_slot(v, cache_bits)] = v
            kept += 1

    while at < len(out):
        own = tables[groups[at // width >> group_bits, at % width >> group_bits] if groups is not None else 0]
        s = reader.symbol(own[0])
        if s < 256:
            r, b, a = (reader.symbol(own[k]) for k in (1, 2, 3))
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = read_extra(reader, s - 256)
            code = read_extra(reader, reader.symbol(own[4]))
            distance = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if distance > at or at + length > len(out):
                raise ValueError("a back-reference leaves the image")
            while length:
                n = min(length, distance)
                out[at : at + n] = out[at - distance : at - distance + n]
                at += n
                length -= n
        else:
            remember()
            out[at] = cache[s - 280]
            at += 1
    return out.reshape(height, width)


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def predicted(mode: int, left, top, right, corner) -> np.ndarray:
    """Prediction of a pixel (channels as an array) from its neighbours: left, top, top right, top left."""
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = average(left, top)
        return np.clip(half + np.trunc((half - corner) / 2).astype(np.int64), 0, 255)
    plain = (
        lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: average(average(left, right), top), lambda: average(left, corner), lambda: average(left, top),
        lambda: average(corner, top), lambda: average(top, right), lambda: average(average(left, corner), average(top, right)),
    )
    return plain[mode]() if mode < len(plain) else np.array([255, 0, 0, 0])


def _predict_even(given: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """`predict` where all blocks take the pixel above (2) or to the left (1): whole rows or columns at a time. The first row goes by the left, the first column by the pixel above, the first pixel by black."""
    first = np.array([255, 0, 0, 0])
    out = np.empty_like(given)
    if forward:
        out[0, 0] = given[0, 0] - first
        out[0, 1:] = given[0, 1:] - given[0, :-1]
        out[1:, 0] = given[1:, 0] - given[:-1, 0]
        out[1:, 1:] = given[1:, 1:] - (given[:-1, 1:] if mode == 2 else given[1:, :-1])
    else:
        out[:] = given
        out[0, 0] += first
        out[0] = np.cumsum(out[0], axis=0)
        if mode == 2:
            out = np.cumsum(out, axis=0)
        else:
            out[:, 0] = np.cumsum(out[:, 0], axis=0)
            out[1:] = np.cumsum(out[1:], axis=1)
    return merge(*np.moveaxis(out & 255, 2, 0))


def predict(image: np.ndarray, size_bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    """Residuals of an image (forward) or the image of its residuals."""
    height, width = image.shape
    given = split(image.ravel()).T.reshape(height, width, 4)
    if (modes == 2).all() or (modes == 1).all():
        return _predict_even(given, int(modes.flat[0]), forward)
    out = np.zeros_like(given)
    known = given if forward else out
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = known[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = known[y - 1, 0]
            else:
                right = known[y - 1, x + 1] if x + 1 < width else known[y, 0]
                guess = predicted(int(modes[y >> size_bits, x >> size_bits]), known[y, x - 1], known[y - 1, x], right, known[y - 1, x - 1])
            out[y, x] = given[y, x] - guess & 255 if forward else given[y, x] + guess & 255
    return merge(*np.moveaxis(out, 2, 0))


def signed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64) & 255
    return np.where(x > 127, x - 256, x)


def cross(image: np.ndarray, size_bits: int, elements: np.ndarray, forward: bool) -> np.ndarray:
    """Takes from red and blue (forward), or gives back, what green and red tell of them."""
    height, width = image.shape
    own = elements[np.ix_(np.arange(height) >> size_bits, np.arange(width) >> size_bits)]
    _, red_to_blue, green_to_blue, green_to_red = split(own)
    a, r, g, b = split(image)

    def delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
        return signed(factor) * signed(colour) >> 5

    sign = -1 if forward else 1
    red = r + sign * delta(green_to_red, g) & 255
    blue = b + sign * (delta(green_to_blue, g) + delta(red_to_blue, r if forward else red)) & 255
    return merge(a, red, g, blue)


def body_of(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def read_head(reader: Reader) -> tuple[int, int]:
    if reader.get(8) != 0x2F:
        raise ValueError("no lossless WebP signature")
    width, height = reader.get(14) + 1, reader.get(14) + 1
    reader.get(1)
    if reader.get(3):
        raise ValueError("unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, ARGB) of one lossless WebP file."""
    reader = Reader(body_of(data))
    width, height = read_head(reader)
    undo, seen = [], set()
    while reader.get(1):
        kind = reader.get(2)
        if kind in seen:
            raise ValueError("a transform is repeated")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = reader.get(3) + 2
            undo.append((kind, size_bits, read_pixels(reader, blocks(width, size_bits), blocks(height, size_bits), False)))
        elif kind == PALETTE:
            count = reader.get(8) + 1
            colours = merge(*np.cumsum(split(read_pixels(reader, count, 1, False).ravel()), axis=1))
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((kind, width, pack, colours))
            width = blocks(width, pack)
        else:
            undo.append((kind,))
    image = read_pixels(reader, width, height, True)
    for kind, *rest in reversed(undo):
        if kind == PREDICTOR:
            image = predict(image, rest[0], rest[1] >> 8 & 15, forward=False)
        elif kind == CROSS_COLOUR:
            image = cross(image, rest[0], rest[1], forward=False)
        elif kind == SUBTRACT_GREEN:
            a, r, g, b = split(image)
            image = merge(a, r + g, g, b + g)
        else:
            wide, pack, colours = rest
            x = np.arange(wide)
            index = (image[:, x >> pack].astype(np.int64) >> 8 & 255) >> (8 >> pack) * (x & (1 << pack) - 1) & (1 << (8 >> pack)) - 1
            image = np.concatenate([colours, np.zeros(256, np.uint32)])[index]
    return image


def plain_tables(reader: Reader) -> list[np.ndarray] | None:
    """Tables of the four channels if the stream has no transform, cache, or further group; else None."""
    if reader.get(1) or reader.get(1) or reader.get(1):
        return None
    lengths = [read_lengths(reader, a) for a in (280, 256, 256, 256, 40)]
    return None if lengths[0][256:].any() else [lookup(x) for x in lengths[:4]]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of many files. Plain ones advance side by side, the longest first, each step a symbol of all that are not done."""
    out: list[np.ndarray | None] = [None] * len(files)
    lanes, kept = [], []
    known: list[tuple[bytes, int, int, int]] = []  # whole bytes of a description, its last bits, their mask, where it ends
    for i, data in enumerate(files):
        body = body_of(data)
        reader = Reader(body[:1024])
        width, height = read_head(reader)
        for k, (whole, last, mask, end) in enumerate(known):  # images of one encoder describe the same codes: their tables are built once
            if body.startswith(whole, HEAD) and (not mask or body[HEAD + len(whole)] & mask == last):
                lanes.append((width * height, i, end, k, width, height))
                break
        else:
            reader = Reader(body)
            reader.at = 8 * HEAD
            tables = plain_tables(reader)
            if tables is None:
                out[i] = decode(data)
                continue
            size, mask = (reader.at >> 3) - HEAD, (1 << (reader.at & 7)) - 1
            lanes.append((width * height, i, reader.at, len(kept), width, height))
            known.append((body[HEAD : HEAD + size], body[HEAD + size] & mask if mask else 0, mask, reader.at))
            kept.append(tables)
    if not lanes:
        return out  # type: ignore[return-value]
    lanes.sort(key=lambda x: -x[0])
    counts = np.array([x[0] for x in lanes])
    bodies = [body_of(files[x[1]]) for x in lanes]
    base = np.cumsum([0, *(len(b) for b in bodies[:-1])])
    data = np.frombuffer(b"".join(bodies) + b"\0" * 8, np.uint8)
    at = np.array([x[2] for x in lanes]) + 8 * base
    which = np.array([x[3] for x in lanes])
    tables = [np.concatenate([k[c] for k in kept]) for c in range(4)]
    shift = which << LONGEST
    pixels = np.zeros((int(counts.max()), len(lanes)), np.uint32)
    places = (8, 16, 0, 24)
    windows = (data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24)
    active = np.searchsorted(-counts, -np.arange(len(pixels)), side="left")
    for step, n in enumerate(active.tolist()):
        now, own, row = at[:n], shift[:n], pixels[step, :n]
        for table, place in zip(tables, places, strict=True):
            found = table[own + (windows[now >> 3] >> (now & 7).astype(np.uint32) & 0x7FFF)]
            now += found & 15
            row |= (found >> 4).astype(np.uint32) << np.uint32(place)
    limits = 8 * (base + [len(b) for b in bodies])
    if (at > limits).any():
        raise ValueError("a stream ends early")
    for k, (count, i, _, _, width, height) in enumerate(lanes):
        out[i] = pixels[:count, k].reshape(height, width)
    return out  # type: ignore[return-value]
