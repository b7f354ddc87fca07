"""N-gram Jaccard join by grouped prefixes.

Two documents link when their sets of word shingles overlap enough. Sets are
put in one order of all shingles (rare ones first, then by hash); two sets that
link share a shingle within their prefixes. Documents with identical prefixes
and size form a group, only groups enter the postings of prefix shingles, and
groups that meet there are filtered by size and position, expanded to their
distinct sets, and verified on whole texts, word by word.

What is asked for is which documents links connect, so not all pairs are
needed. A first round verifies each group with the first one of its size band
in each posting; a second one lets each set take a few partners that bitmaps of
the sets do not rule out, which joins the near copies of large groups; the last
one verifies every remaining pair of sets that meet in a posting, can link, and
are not connected yet. A pair left out is connected already, so no link between
two components is lost, and no group's pairs are all emitted.

Two things keep down the pairs that meet but do not link. The order counts
shingles wherever prefixes come to lie, so copies that differ more than a link
allows show their own shingles first and fail by position. And a bitmap has at
least as many bits as its set has shingles, up to a bound, so it tells long sets
apart too. Rows that meet are narrow; bitmaps go once to each task that needs
them, and a posting of many rows is cut into blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut, exchange_width, text_bytes
from ._words import U, batches, claim, lists, longs, mix, shingle_sets

WORDS, PERCENT = 5, 80
LEAST_FREQUENT, MOST_FREQUENT = 16, 1 << 21  # of the shingles put last in the order: rows of each, and how many
POSTINGS = 1 << 20  # rows of postings a task holds
LEAST_BITMAP, MOST_BITMAP = 1 << 10, 1 << 15  # bits
MEETING = 1024  # sets of a token that meet in one block
FEW_EDGES = 1 << 18  # edges that one task unites
PARTNERS = 4  # pairs a set takes part in, per posting, before large components have formed


def prefix_length(n: int, percent: int) -> int:
    """Two sets with the asked overlap share one of this many first elements of each."""
    return n + (-percent * n // 100) + 1


def _held(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _count(n: int, percent: int, frequent=None):
    """Shingles and in how many sets they are: those of prefixes by hash alone; with `frequent`, those that follow where a prefix holds frequent ones."""

    def asked(s: np.ndarray) -> np.ndarray:
        p = prefix_length(len(s), percent)
        if frequent is None:
            return s[:p]
        late = int(_held(frequent.value, s[:p]).sum())
        return s[p : p + 2 * late + 16] if 4 * late < p else s[p:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        waiting: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([*waiting, np.empty(0, U)]), return_counts=True)
            waiting.clear()
            return pa.record_batch({"token": pa.array(longs(tokens)), "n": pa.array(counts.astype(np.int64))})

        for batch in parts:
            for _, texts in batches(batch):
                waiting += [asked(s).copy() for s in shingle_sets(texts, n) if len(s)]
                if sum(map(len, waiting)) > POSTINGS:
                    yield out()
        yield out()

    return run


def frequent_shingles(docs: DataFrame, n: int, percent: int) -> np.ndarray:
    """Sorted hashes of the shingles that most documents hold: at most MOST_FREQUENT, counted over all documents.

    A first count takes the prefixes that hashes alone would give. Where many of
    a set's prefix are frequent its prefix moves on to shingles that nobody has
    counted yet, so a second count takes those.
    """

    def most(counts: DataFrame) -> np.ndarray:
        least, held = 64, 0
        for power, rows in sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()), reverse=True):
            held += rows
            if held > MOST_FREQUENT:
                break
            least = power
        tokens = counts.where(F.floor(F.log2("n")) >= least).select("token").toArrow().column("token").to_numpy()
        return np.sort(np.ascontiguousarray(tokens).view(U))

    def count(frequent=None) -> DataFrame:
        counts = docs.select("text").mapInArrow(_count(n, percent, frequent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        return cut(counts.where(F.col("n") >= LEAST_FREQUENT), "jaccard-frequent")

    first = count()
    shared = docs.sparkSession.sparkContext.broadcast(most(first))
    every = first.union(count(shared)).groupBy("token").agg(F.sum("n").alias("n"))
    found = most(every)
    shared.unpersist()
    return found


def _sign(frequent, n: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        last = frequent.value
        known: set[int] = set()
        for batch in parts:
            for part, texts in batches(batch):
                sets = list(shingle_sets(texts, n))
                lengths = [prefix_length(len(s), percent) if len(s) else 0 for s in sets]
                heads = [s[: 2 * p + 16] for s, p in zip(sets, lengths, strict=True)]
                flags = np.split(_held(last, np.concatenate(heads)), np.cumsum([len(h) for h in heads])[:-1])
                prefixes, keys, first, second, maps = [], [], [], [], []
                for s, p, head, flag in zip(sets, lengths, heads, flags, strict=True):
                    prefix = head[~flag][:p]
                    if len(prefix) < p:
                        late = _held(last, s)
                        prefix = np.concatenate([s[~late], s[late]])[:p]
                    prefixes.append(prefix)
                    keys.append(int(mix(np.array([np.sum(mix(prefix ^ U(0x5851F42D4C957F2D)), dtype=U) + U(len(s))], U))[0]))
                    first.append(np.sum(mix(s ^ U(0xA3B195354A39B70D)), dtype=U))
                    second.append(np.sum(mix(s ^ U(0x1B03738712FAD5C9)), dtype=U))
                    maps.append(bitmap(s))
                # a prefix goes along once per task and group: copies collapse before the exchange
                new = [not (k in known or known.add(k)) and p > 0 for k, p in zip(keys, lengths, strict=True)]
                if len(known) > POSTINGS:
                    known.clear()
                shown = lists([x if go else x[:0] for x, go in zip(prefixes, new, strict=True)])
                part = part.drop_columns(["text"])
                for name, values in (("n", pa.array([len(s) for s in sets], pa.int32())), ("set_a", pa.array(longs(np.array(first, U)))), ("set_b", pa.array(longs(np.array(second, U)))), ("group", pa.array(longs(np.array(keys, U)))), ("bits", pa.array(maps, pa.binary())), ("prefix", shown)):
                    part = part.append_column(name, values)
                yield part

    return run


def bitmap(s: np.ndarray) -> bytes:
    """A set's parity bitmap, of at least as many bits as elements up to MOST_BITMAP: each element flips one bit. Two bitmaps of one length differ in at most as many bits as the sets in elements."""
    size = min(MOST_BITMAP, max(LEAST_BITMAP, 1 << (len(s) - 1).bit_length() if len(s) else 1))
    flips = np.bincount((s & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of many sets, one table for each length. A long one folds to half by XOR of its halves."""

    def __init__(self, maps: list[bytes]) -> None:
        self.length = np.array([len(m) for m in maps], np.int64)
        self.row = np.zeros(len(maps), np.int64)
        self.tables = {}
        for length in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == length)
            self.row[own] = np.arange(len(own))
            self.tables[length] = np.frombuffer(b"".join(maps[i] for i in own.tolist()), U).reshape(len(own), -1)

    def _rows(self, at: np.ndarray, length: int) -> np.ndarray:
        out = np.empty((len(at), length // 8), U)
        for own in np.unique(self.length[at]).tolist():
            here = self.length[at] == own
            bits = self.tables[own][self.row[at[here]]]
            while bits.shape[1] > length // 8:
                half = bits.shape[1] // 2
                bits = bits[:, :half] ^ bits[:, half:]
            out[here] = bits
        return out

    def near(self, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets i and j (n[i] <= n[j]) can have the overlap: their difference is at most what it allows."""
        out = np.empty(len(i), bool)
        for length in np.unique(self.length[i]).tolist():
            here = np.flatnonzero(self.length[i] == length)
            for at in range(0, len(here), max(1, (1 << 24) // length)):
                some = here[at : at + max(1, (1 << 24) // length)]
                apart = np.bitwise_count(self._rows(i[some], length) ^ self._rows(j[some], length)).sum(axis=1, dtype=np.int64)
                out[some] = (100 + percent) * apart <= (100 - percent) * (n[i[some]] + n[j[some]])
        return out


def may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m whose first shared element stands at positions at and bt can have the overlap.

    Pairs that link pass where their first shared element is posted; that they,
    or others, may fail at later ones loses nothing.
    """
    return (100 + percent) * np.minimum(n - at, m - bt) >= percent * (n + m)


def _table(parts: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    found = list(parts)
    return [np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in found]) if found else np.empty(0, np.int64) for c in names]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start, and the end."""
    return np.append(np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _post(percent: int):
    """Postings that more than one group shares, each row with the first group of its size band (itself if they cannot link), and whether just two groups meet there: then the first one leads whatever their bands, and their only pair is taken."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        token, group, n, pos = _table(parts, ["token", "group", "n", "pos"])
        order = np.lexsort((group, n, token))
        token, group, n, pos = token[order], group[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        lengths = np.diff(_starts(token))
        keep = np.repeat(lengths > 1, lengths)
        token, group, n, pos = token[keep], group[keep], n[keep], pos[keep]
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64) if percent < 100 else n
        two = np.repeat(lengths[lengths > 1] == 2, lengths[lengths > 1])
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1]) & ~two[1:]
        head = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        leader = np.where(may_link(n, pos, n[head], pos[head], percent), group[head], group)
        for i in range(0, len(token), 1 << 16):
            at = slice(i, i + (1 << 16))
            yield pa.record_batch({"token": pa.array(token[at]), "group": pa.array(group[at]), "n": pa.array(n[at].astype(np.int32)), "pos": pa.array(pos[at].astype(np.int32)), "leader": pa.array(leader[at]), "two": pa.array(two[at])})

    return run


def _cross(percent: int, partners: int | None):
    """Distinct pairs of unconnected nodes that meet in a unit (see `dealt`) and can link by size, position and bitmap; with `partners`, each node takes part as the smaller one in at most so many per unit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        found, maps = [], {}
        for batch in parts:
            bits = batch.column(7)
            held = bits.is_valid()
            mapped = batch.filter(held)
            maps |= zip(mapped.column(2).to_pylist(), mapped.column(7).to_pylist(), strict=True)
            found.append(batch.filter(pc.invert(held)))
        unit, node, n, pos, comp, role = _table(iter(found), ["unit", "node", "n", "pos", "comp", "role"])
        found.clear()
        order = np.lexsort((node, n, unit))
        unit, node, n, pos, comp, role = unit[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64), comp[order], role[order]
        names, row = np.unique(node, return_inverse=True)
        bits = Bitmaps([maps[k] for k in names.tolist()])
        maps.clear()
        starts = _starts(unit)
        ends = np.repeat(starts[1:], np.diff(starts))
        left, taken = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        size_of = np.zeros(len(names), np.int64)
        size_of[row] = n
        pairs: list[np.ndarray] = []
        size = step = 0

        def out() -> pa.RecordBatch:
            once = np.unique(np.concatenate([*pairs, np.empty((2, 0), np.int64)], axis=1), axis=1)
            pairs.clear()
            return pa.record_batch({"a": pa.array(once[0]), "b": pa.array(once[1])})

        while len(left):  # every row with the row `step` behind it in its unit, while that one is not too large
            step += 1
            left = left[left + step < ends[left]]
            left = left[percent * n[left + step] <= 100 * n[left]]
            if partners is not None:
                left = left[taken[left] < partners]
            i = left[(comp[left] != comp[left + step]) & ((role[left] == 2) | (role[left] != role[left + step]))]
            i = i[may_link(n[i], pos[i], n[i + step], pos[i + step], percent)]
            i = i[bits.near(size_of, row[i], row[i + step], percent)]
            if len(i):
                taken[i] += 1
                pairs.append(np.stack([np.minimum(node[i], node[i + step]), np.maximum(node[i], node[i + step])]))
                size += len(i)
            if size > POSTINGS:
                yield out()
                size = 0
        yield out()

    return run


def dealt(rows: DataFrame, bits: DataFrame, width: int, block: int, every: bool = True) -> DataFrame:
    """Rows (token, node, n, pos, comp) for `_cross`: those of a token are a unit; more than `block` of them are cut into blocks by hash, and each block with itself and each two blocks are units, so that no task holds more than two; blocks meet themselves alone unless `every`. Bitmaps (node, bits) go along as rows of their own, once per node and slot of units."""
    role = lambda i, j, r: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(r).alias("role"))
    rows = cut(rows, "jaccard-rows")
    large = rows.groupBy("token").count().where(F.col("count") > block).select("token", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    split = rows.join(broadcast_if(cut(large, "jaccard-large")), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    own = F.col("own")
    others = F.sequence(F.lit(0), F.col("blocks") - 1) if every else F.array(own)
    met = F.transform(others, lambda k: F.when(k == own, role(own, own, 2)).when(k < own, role(k, own, 1)).otherwise(role(own, k, 0)))
    units = split.withColumn("met", F.explode(met)).withColumn("unit", F.xxhash64("token", "met.i", "met.j"))
    units = units.select(F.pmod("unit", F.lit(width)).cast("int").alias("slot"), "unit", "node", "n", "pos", "comp", "met.role")
    units = cut(units, "jaccard-units")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    maps = units.select("slot", "node").distinct().join(bits.select("node", "bits"), "node").select("slot", none("unit", "long"), "node", none("n", "int"), none("pos", "int"), none("comp", "long"), none("role", "int"), "bits")
    return units.withColumn("bits", F.lit(None).cast("binary")).unionByName(maps).repartition(width, "slot")


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text its distinct shingles as ascending ranks of the shingles themselves, no hashes: words are numbered by their bytes."""
    numbers: dict[bytes, int] = {}
    rows, owners = [], []
    for i, text in enumerate(texts):
        words = np.array([numbers.setdefault(w, len(numbers) + 1) for w in text.lower().split()], np.int32)
        short = np.zeros(n, np.int32)
        short[: min(n, len(words))] = words[:n]
        rows.append(np.lib.stride_tricks.sliding_window_view(words, n) if len(words) >= n else short[None, :] if len(words) else np.empty((0, n), np.int32))
        owners.append(np.full(len(rows[-1]), i))
    every = np.ascontiguousarray(np.concatenate([*rows, np.empty((0, n), np.int32)]))
    _, rank = np.unique(every.view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
    pairs = np.unique(np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64) << 32 | rank)
    return np.split(pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(1, len(texts)))) if texts else []


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) share `percent` of their union."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared)


def _verify(n: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for batch in parts:
            for part, _ in batches(batch, "text_a"):
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                texts: dict[int, bytes] = {}
                for ids, column in ((a, part.column(2)), (b, part.column(3))):
                    texts |= zip(ids.tolist(), column.cast(pa.binary()).to_pylist(), strict=True)
                pairs = list(zip(a.tolist(), b.tolist(), strict=True))
                # hashes tell pairs that are far from linking, words decide on the rest
                hashed = dict(zip(texts, shingle_sets(list(texts.values()), n), strict=True))
                close = [linked(hashed[x], hashed[y], percent - 5) for x, y in pairs]
                needed = {k: texts[k] for near, pair in zip(close, pairs, strict=True) if near for k in pair}
                sets = dict(zip(needed, exact_sets(list(needed.values()), n), strict=True))
                keep = np.array([near and linked(sets[x], sets[y], percent) for near, (x, y) in zip(close, pairs, strict=True)], bool)
                yield pa.record_batch({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return run


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole texts link."""
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "rep_doc", "rep_text"), "node")
    needed = broadcast_if(cut(needed.select("node", "rep_doc", "rep_text").dropDuplicates(["node"]), "jaccard-needed"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = own.join(needed, (F.col("hash") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_doc")))
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]), "jaccard-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long"), "jaccard-links")


def _united(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of the components of a task's edges (a, b)."""
    claim("jaccard")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in parts:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    nodes = list(parent)
    yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "comp": pa.array([root(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components: node, comp, for every node of the edges (a, b).

    Each round every node takes the neighbour of least random rank, if below
    its own, as parent, and edges contract to the parents of parents; a fixed
    share of nodes is expected to vanish each round, whatever the shape. Once
    at most `few` edges are left, one task unites them.
    """
    edges = cut(edges.where("a <> b").distinct(), "components-edges")
    labels, rounds = None, 0
    while edges.count() > few:
        def rank(c: str, salt: int = rounds) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), c), F.col(c))

        if labels is None:
            labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
        around = edges.union(edges.select("b", "a"))
        least = around.groupBy("a").agg(F.min(rank("b")).alias("least"))
        parents = cut(least.select(F.col("a").alias("node"), F.when(F.struct(F.col("least")["col1"], F.col("least")["b"]) < rank("a"), F.col("least")["b"]).otherwise(F.col("a")).alias("parent")), "components-parents")
        grand = parents.select("node", "parent").join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent").select("node", "top")
        grand = cut(grand, "components-tops")
        labels = cut(labels.join(grand.select(F.col("node").alias("comp"), "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components-labels")
        edges = edges.join(grand.select(F.col("node").alias("a"), F.col("top").alias("top_a")), "a").join(grand.select(F.col("node").alias("b"), F.col("top").alias("top_b")), "b")
        edges = cut(edges.where("top_a <> top_b").select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "components-edges")
        rounds += 1
    united = cut(edges.coalesce(1).mapInArrow(_united, "node long, comp long"), "components-united")
    if labels is None:
        return united
    return cut(labels.join(united.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components-labels")


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels (node, comp) after components merged (node: an old one, comp: the new one)."""
    found = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    return cut(found.select("node", F.coalesce("top", "comp").alias("comp")), "jaccard-labels")


def _meeting(postings: DataFrame, classes: DataFrame, labels: DataFrame, width: int, block: int, every: bool) -> DataFrame:
    """`dealt` rows of postings, and of groups of several sets, where different components meet."""
    nodes = classes.select("group", "node", "n").join(labels, "node")
    own = nodes.select(F.col("group").alias("token"), "group", F.lit(0).alias("pos"), "comp")
    met = postings.select("token", "group", "pos").join(nodes.select("group", "comp").distinct(), "group").select("token", "group", "pos", "comp")
    narrow = met.union(own.select("token", "group", "pos", "comp"))
    mixed = narrow.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    mixed = cut(mixed, "jaccard-mixed")
    entries = postings.select("token", "group", "pos").union(classes.select(F.col("group").alias("token"), "group", F.lit(0).alias("pos")).distinct())
    entries = entries.join(broadcast_if(mixed), "token", "left_semi")
    return dealt(entries.join(nodes, "group").select("token", "node", "n", "pos", "comp"), classes, width, block, every)


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, block: int = MEETING) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct
    runs of `n` words, of a shorter text the whole sequence as one. Documents
    link when 100 * intersection >= percent * union; component_id is the least
    doc_id that links reach. Null or empty text, or white space alone, has no
    shingles and links with nothing, not even its like: component_id is its own
    id. Equal sets are told by two 64-bit hashes, links between different ones
    by their words. Rows with one doc_id but different texts are one document with several
    sets. Rows without an id link by text, but give components no name: null if
    no other does. An empty table gives an empty result; other columns are ignored.
    """
    return components_of(docs, n, percent, block).select("doc_id", "n_shingles", "component_id")


def components_of(docs: DataFrame, n: int, percent: int, block: int = MEETING) -> DataFrame:
    """`jaccard_components` with text_hash and stays: whether the row is the one (or like the one) that stays of its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, n, percent))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = cut(keyed.mapInArrow(_sign(frequent, n, percent), "doc_id long, text_hash long, n int, set_a long, set_b long, group long, bits binary, prefix array<long>"), "jaccard-signed")

    node_of = F.xxhash64("n", "set_a", "set_b")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = signed.where("n > 0").groupBy("group", "n", "set_a", "set_b").agg(rep.alias("rep"), F.min("bits").alias("bits"))
    classes = cut(classes.select("group", "n", "set_a", "set_b", "bits", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.text_hash").alias("rep_text"), node_of.alias("node")), "jaccard-classes")

    groups = signed.where(F.size("prefix") > 0).groupBy("group").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = groups.select("group", "n", F.posexplode("prefix").alias("pos", "token"))
    width = exchange_width(spark, text_bytes(docs) // 30, POSTINGS)
    postings = entries.repartition(width, "token").mapInArrow(_post(percent), "token long, group long, n int, pos int, leader long, two boolean")
    postings = cut(postings, "jaccard-postings")

    leads = classes.groupBy("group").agg(F.min("node").alias("lead"))
    met = postings.where("leader <> group").select("leader", "group").distinct()
    stars = met.join(leads, "group").withColumnRenamed("lead", "a").join(leads.select(F.col("group").alias("leader"), F.col("lead").alias("b")), "leader").select("a", "b")
    inside = classes.join(leads, "group").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    of_id = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(node_of).alias("a"), F.max(node_of).alias("b"), F.collect_set(node_of).alias("all")).where("a <> b")
    alike = of_id.select("a", F.explode("all").alias("b")).where("a <> b")
    first = components(verified(stars.union(inside), classes, docs, n, percent).union(alike))

    # where two groups of one set each meet, their pair was in the first round
    several = cut(classes.groupBy("group").count().where("count > 1").select("group"), "jaccard-several")
    again = postings.where("two").join(several, "group", "left_semi").select("token").distinct()
    postings = postings.where("NOT two").unionByName(postings.where("two").join(again, "token", "left_semi"))

    labels = _relabelled(classes.select("node", F.col("node").alias("comp")).distinct(), first)
    for partners in (PARTNERS, None):
        crossed = _meeting(postings, classes, labels, width, block, partners is None).mapInArrow(_cross(percent, partners), "a long, b long")
        links = verified(crossed, classes, docs, n, percent)
        over = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b")
        labels = _relabelled(labels, components(over.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))))
    final = classes.join(labels, "node").withColumnRenamed("comp", "top")
    stays = F.min(F.struct(F.col("rep_doc").isNull(), "rep_doc", "rep_text"))
    names = final.groupBy("top").agg(F.min("rep_doc").alias("component_id"), stays.alias("stays"))
    named = cut(final.join(names, "top").select("n", "set_a", "set_b", "component_id", F.col("stays.rep_doc").alias("keep_doc"), F.col("stays.rep_text").alias("keep_text")), "jaccard-named")
    out = signed.select("doc_id", "text_hash", "n", "set_a", "set_b").join(named, ["n", "set_a", "set_b"], "left")
    stay = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("text_hash") == F.col("keep_text")))
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), stay.alias("stays"))


def near_duplicates_removed(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` without near copies: of each component the row with the least doc_id stays (null ids last, then by the text's hash).

    Texts without words stay, each as it is; of rows alike in doc_id and text one
    does. Null text counts as empty. An empty table gives an empty one; other
    columns go along, those named `__near_...` are replaced.
    """
    stay = components_of(docs, n, percent).where("stays").select("doc_id", "text_hash").distinct()

    def keys(df: DataFrame, hashed: Column) -> DataFrame:
        return df.withColumn("__near_null", F.col("doc_id").isNull()).withColumn("__near_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__near_hash", hashed)

    names = ["__near_null", "__near_id", "__near_hash"]
    own = keys(docs.drop(*names), F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(keys(stay, F.col("text_hash")).select(*names), names, "left_semi").dropDuplicates(names).select(*[c for c in docs.columns if c not in names])
