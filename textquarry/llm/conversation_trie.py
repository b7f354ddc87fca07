"""Prefix trie of conversations, built shard by shard as double arrays.

Conversations are put together again from narrow rows (hashes and sizes of
turns, no texts), equal sequences collapse, and each distinct one goes to the
shard of a prefix of it. A shard numbers its turns densely, packs the trie of
its sequences into BASE and CHECK arrays, and traverses these for the nodes.
The shard's prefix is the first one, of 1, 2, 4, 8 ... turns, that is not too
heavy for a task. Nodes from there on belong to that shard alone and are
complete; those above it are shared by shards, which give partial aggregates
that are merged globally and summed up along the tree in rounds of doubling
distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_if, cut, exchange_width
from ._words import U, claim, longs, mix

TURNS, SEQUENCES = 1 << 16, 1024  # a prefix with more turns below it, in more sequences, is too heavy for one shard
GROUP, HEADS = 5, 9  # conversations of a group share its first one's head, of fewer than HEADS turns
PIECE = 1 << 20
TURN = np.dtype([("a", "<i8"), ("b", "<i8"), ("bytes", "<i8")])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = pa.schema(
    [("shared", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("up_a", pa.int64()), ("up_b", pa.int64())]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes")]
    + [("ends_sha256", pa.string())]
)
NODE_DDL = "shared boolean, a long, b long, up_a long, up_b long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, and turns (turn, a, b, bytes) of the rebuilt conversation in order: a and b are hashes of role and text, bytes the text's size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    narrow = turns.where("conv_id IS NOT NULL").select(
        (conv - F.pmod(conv, F.lit(group))).alias("base"),
        conv.alias("conv_id"),
        F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"),
    )
    width = exchange_width(turns.sparkSession, turns.count() * 48, 32 << 20)
    own = narrow.repartition(width, "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, heads).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("own", F.lit(1), F.lit(0)))
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def prefix_hashes(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each prefix of sequences laid end to end: per sequence 1 + its length of them, the first of the empty prefix."""
    ends = np.cumsum(counts)
    longest = int(counts.max(initial=0))
    depth = np.arange(len(a)) - np.repeat(ends - counts, counts)
    at = np.arange(len(a)) + np.repeat(np.arange(len(counts)), counts) + 1  # places behind the empty prefixes
    every = np.arange(len(a) + len(counts)) - np.repeat(ends - counts + np.arange(len(counts)), counts + 1)
    found = []
    for values, base in ((a, 0x9E3779B97F4A7C15), (b, 0xD6E8FEB86659FD93)):
        power = np.full(longest + 1, U(base))
        power[0] = U(1)
        power = np.multiply.accumulate(power)
        sums = np.zeros(len(a) + len(counts), U)
        sums[at] = mix(values.view(U)) * power[depth]
        sums = np.cumsum(sums, dtype=U)
        start = sums[ends - counts + np.arange(len(counts))]
        found.append(mix(sums - np.repeat(start, counts + 1) + every.astype(U) * U(0xA0761D6478BD642F)))
    return found[0], found[1]


def _chain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the hashes of its sequence, its turns packed, and the hashes of its prefixes of 1, 2, 4 ... turns."""
    claim("trie")
    for batch in parts:
        turns = batch.column(1)
        counts = turns.value_lengths().to_numpy().astype(np.int64)
        flat = turns.flatten()
        packed = np.empty(len(flat), TURN)
        for c in TURN.names:
            packed[c] = flat.field(c).to_numpy()
        p, q = prefix_hashes(np.ascontiguousarray(packed["a"]), np.ascontiguousarray(packed["b"]), counts)
        starts = np.cumsum(counts) - counts
        roots = starts + np.arange(len(counts))
        last = roots + counts
        depths = [1 << k for k in range(int(counts.max(initial=0)).bit_length())]
        marks = [r + d for r, n in zip(roots.tolist(), counts.tolist(), strict=True) for d in depths if d <= n]
        offsets = np.concatenate([[0], np.cumsum([int(n).bit_length() for n in counts.tolist()])]).astype(np.int32)
        marks = pa.StructArray.from_arrays([pa.array(longs(x[marks] if marks else x[:0])) for x in (p, q)], ["a", "b"])
        yield pa.record_batch(
            {
                "conv_id": batch.column(0),
                "a": pa.array(longs(p[last])),
                "b": pa.array(longs(q[last])),
                "n": pa.array(counts),
                "turns": pa.array([packed[s : s + n].tobytes() for s, n in zip(starts.tolist(), counts.tolist(), strict=True)], pa.binary()),
                "marks": pa.ListArray.from_arrays(pa.array(offsets), marks),
            }
        )


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, b, conv_id) as one row for each (a, b): the digest of its ids. What the task may hold only a part of, or is long, goes on as pieces."""
    claim("trie")
    at, first, whole = None, 0, False  # the key at hand, its piece's first id, and whether all of it is here so far
    ids: list[bytes] = []
    size = 0
    rows: list[tuple] = []

    def piece() -> None:
        nonlocal size
        rows.append((*at, first, b",".join(ids), None))
        ids.clear()
        size = 0

    def out() -> pa.RecordBatch:
        a, b, no, data, sha = zip(*rows, strict=True) if rows else [()] * 5
        rows.clear()
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "no": pa.array(no, pa.int64()), "piece": pa.array(data, pa.binary()), "sha": pa.array(sha, pa.string())})

    begun = False
    for batch in parts:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (a, b):
                if at is not None:
                    if whole:
                        rows.append((*at, first, None, hashlib.sha256(b",".join(ids)).hexdigest()))
                        ids.clear()
                        size = 0
                    elif ids:
                        piece()
                at, whole, begun = (a, b), begun, True
            if not ids:
                first = conv
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
            if size > PIECE:
                piece()
                whole = False
                yield out()
        yield out()
    if ids:
        piece()
    yield out()


def _glued(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (a, b, no, piece) as one digest for each (a, b)."""
    claim("trie")
    at, digest = None, None
    rows: list[tuple] = []
    for batch in parts:
        for a, b, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == (a, b):
                digest.update(b",")
            else:
                if at is not None:
                    rows.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256()
            digest.update(piece)
    if at is not None:
        rows.append((*at, digest.hexdigest()))
    a, b, sha = zip(*rows, strict=True) if rows else [()] * 3
    yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends": pa.array(sha, pa.string())})


def ends(chains: DataFrame) -> DataFrame:
    """a, b, ends: SHA-256 of the ids of the conversations that are this sequence, ascending and comma-joined.

    Ids are dealt by range, so many of one sequence are spread over tasks; only
    what meets a task's edge goes on, as pieces of text that one task streams.
    """
    width = exchange_width(chains.sparkSession, chains.count() * 24, 16 << 20)
    dealt = chains.select("a", "b", "conv_id").repartitionByRange(width, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    found = cut(dealt.mapInArrow(_joined, "a long, b long, no long, piece binary, sha string"), "trie-ends")
    pieces = found.where("sha IS NULL").select("a", "b", "no", "piece").repartition(width, "a", "b").sortWithinPartitions("a", "b", "no")
    return found.where("sha IS NOT NULL").select("a", "b", F.col("sha").alias("ends")).union(pieces.mapInArrow(_glued, "a long, b long, ends string"))


class DoubleArray:
    """A trie over dense ids: the child of state s by id c is BASE[s] + c, if CHECK there is s. State 0 is the root."""

    def __init__(self) -> None:
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no state below it is free

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _frees(self, n: int) -> np.ndarray:
        """The first `n` free states."""
        reach = self.free + 2 * n + 64
        while True:
            self._grow(reach)
            found = np.flatnonzero(self.check[self.free : reach] < 0)[:n] + self.free
            if len(found) == n:
                return found
            reach *= 2

    def insert(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children of states that have none yet: distinct (parent, id), sorted."""
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(starts, len(parents)))
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = ids[s : s + n]
            for state in self._frees(16).tolist():
                places = state - own[0] + own
                self._grow(int(places[-1]) + 1)
                if (self.check[places] < 0).all():
                    break
            else:  # behind all that is taken
                places = int(np.flatnonzero(self.check >= 0)[-1]) + 1 - own[0] + own
                self._grow(int(places[-1]) + 1)
            self.base[parents[s]] = places[0] - own[0]
            self.check[places] = parents[s]
        alone = starts[sizes == 1]
        places = self._frees(len(alone))
        self.base[parents[alone]] = places - ids[alone]
        self.check[places] = parents[alone]
        self.free = int(self._frees(1)[0])

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        to = self.base[states] + ids
        if (self.check[to] != states).any():
            raise ValueError("no such child")
        return to


def pack(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of sequences keys[start : start + count], and the dense id of each key's number; ids rise as nodes are met level by level, so siblings lie close."""
    trie = DoubleArray()
    dense = np.full(int(keys.max(initial=-1)) + 1, -1, np.int64)
    given = 0
    state = np.zeros(len(starts), np.int64)
    for depth in range(int(counts.max(initial=0))):
        rows = np.flatnonzero(counts > depth)
        key = keys[starts[rows] + depth]
        order = np.lexsort((key, state[rows]))
        seen = key[order]
        fresh = seen[dense[seen] < 0]
        _, where = np.unique(fresh, return_index=True)
        fresh = fresh[np.sort(where)]
        dense[fresh] = given + np.arange(len(fresh))
        given += len(fresh)
        pairs = np.unique(np.stack([state[rows], dense[key]], axis=1), axis=0)
        trie.insert(pairs[:, 0], pairs[:, 1])
        state[rows] = trie.step(state[rows], dense[key])
    return trie, dense


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of a shard's sequences: complete from the depth of each one's shard prefix on, in part above."""
    claim("trie")
    counts = table.column("n").to_numpy().astype(np.int64)
    flat = np.frombuffer(b"".join(table.column("turns").to_pylist()), TURN)
    ends_ = np.cumsum(counts)
    starts = ends_ - counts
    weight, conv = table.column("held").to_numpy(), table.column("conv_id").to_numpy()
    own = table.column("own").to_numpy()
    a, b = np.ascontiguousarray(flat["a"]), np.ascontiguousarray(flat["b"])
    keys = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)[1].ravel() if len(flat) else np.empty(0, np.int64)
    trie, dense = pack(keys, starts, counts)
    p, q = (longs(x) for x in prefix_hashes(a, b, counts))
    roots = starts + np.arange(len(counts))

    size = len(trie.base)
    depth, n_convs, least, n_bytes = (np.zeros(size, np.int64) for _ in range(4))
    least[:] = np.iinfo(np.int64).max
    shared = np.zeros(size, bool)
    name = np.zeros((2, size), np.int64)
    sha = np.full(size, None, object)
    state = np.zeros(len(counts), np.int64)
    for d in range(int(counts.max(initial=0)) + 1):
        rows = np.flatnonzero(counts >= d)
        if d:
            state[rows] = trie.step(state[rows], dense[keys[starts[rows] + d - 1]])
            n_bytes[state[rows]] = flat["bytes"][starts[rows] + d - 1]
        at = state[rows]
        depth[at] = d
        np.add.at(n_convs, at, weight[rows])
        np.minimum.at(least, at, conv[rows])
        name[0, at], name[1, at] = p[roots[rows] + d], q[roots[rows] + d]
        shared[at[d < own[rows]]] = True
    sha[state] = table.column("ends").to_pylist()

    nodes = np.flatnonzero(n_convs)
    below = nodes[nodes > 0]
    private = below[~shared[below]]
    n_children = np.bincount(trie.check[private], minlength=size)
    leaves = ((n_children == 0) & ~shared).astype(np.int64)
    saved = np.where(shared, 0, (n_convs - 1) * n_bytes)
    deep = private[np.argsort(-depth[private], kind="stable")]
    for own_level in np.split(deep, np.flatnonzero(np.diff(depth[deep])) + 1):
        np.add.at(leaves, trie.check[own_level], leaves[own_level])
        np.add.at(saved, trie.check[own_level], saved[own_level])
    up = trie.check[nodes]
    top = nodes == 0
    linked = ~top & shared[up]  # what the parent's name is for
    inner = ~top & ~shared[up]
    columns = [
        pa.array(shared[nodes]),
        pa.array(name[0, nodes]),
        pa.array(name[1, nodes]),
        pa.array(name[0, up], mask=~linked),
        pa.array(name[1, up], mask=~linked),
        pa.array(depth[nodes]),
        pa.array(least[nodes]),
        pa.array(least[up], mask=~inner),
        *(pa.array(x[nodes]) for x in (n_convs, n_children, leaves, saved, n_bytes)),
        pa.array(sha[nodes].tolist(), pa.string()),
    ]
    return pa.Table.from_arrays(columns, schema=NODE)


def _summed_up(upper: DataFrame) -> DataFrame:
    """`upper` with n_leaves and saved_tokens summed over the upper nodes below each: rounds that double the distance to the ancestor that a node's sum goes to."""
    depth = upper.agg(F.max("depth")).first()[0] or 0
    sums = upper.select("a", "b", F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b"), "n_leaves", "saved_tokens")
    for _ in range(int(depth).bit_length()):
        given = sums.where("to_a IS NOT NULL").groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        further = sums.where("to_a IS NOT NULL").select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("to_a").alias("next_a"), F.col("to_b").alias("next_b"))
        more = sums.join(given, ["a", "b"], "left").join(further, ["to_a", "to_b"], "left")
        sums = cut(more.select("a", "b", F.col("next_a").alias("to_a"), F.col("next_b").alias("to_b"), (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens")), "trie-sums")
    return upper.drop("n_leaves", "saved_tokens").join(sums.select("a", "b", "n_leaves", "saved_tokens"), ["a", "b"])


def conversation_trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS, most_turns: int = TURNS, most_sequences: int = SEQUENCES) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt as the first h turns of c - c % `group` (all if
    fewer, none if absent), h = crc32(decimal c) % `heads`, then its own turns
    after its first h. Turns are ordered by turn, null first, ties by hashes of
    role and text; repeated rows are turns of their own. Null role or text is
    empty. A node is a distinct sequence of first turns; its conv_id is the
    least one of the conversations that start with it, saved_tokens sums, over
    its subtree, all but one of its conversations times the bytes of its last
    text. Rows without a conv_id belong to no conversation and are left out; an
    empty table has no node, not even a root; other columns are ignored. Turns
    are told apart by two 64-bit hashes. One task holds the hashes of a
    conversation's turns, 24 bytes each, and no texts.
    """
    spark = turns.sparkSession
    chains = cut(rebuilt(turns, group, heads).mapInArrow(_chain, "conv_id long, a long, b long, n long, turns binary, marks array<struct<a: long, b: long>>"), "trie-chains")
    distinct = chains.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"), F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("n", "turns", "marks")))
    sequences = cut(distinct.join(ends(chains), ["a", "b"]), "trie-sequences")

    marks = sequences.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "n", F.posexplode("marks").alias("k", "mark")).select("of_a", "of_b", "n", "k", "mark.a", "mark.b")
    heavy = marks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("below")).where((F.col("sequences") > most_sequences) & (F.col("below") > most_turns)).select("a", "b")
    light = marks.join(broadcast_if(cut(heavy, "trie-heavy")), ["a", "b"], "left_anti")
    light = light.groupBy(F.col("of_a").alias("a"), F.col("of_b").alias("b")).agg(F.min(F.struct("k", "a", "b")).alias("light"))
    below = sequences.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-below // most_turns))
    placed = sequences.join(light, ["a", "b"], "left").select(
        "n", "turns", "held", "conv_id", "ends",
        F.when(F.col("light").isNotNull(), F.expr("shiftleft(1L, light.k)")).otherwise(F.col("n") + 1).alias("own"),
        F.pmod(F.xxhash64(F.coalesce("light.a", "a"), F.coalesce("light.b", "b")), F.lit(shards)).alias("shard"),
    )
    nodes = cut(placed.groupBy("shard").applyInArrow(_shard, NODE_DDL), "trie-nodes")

    upper = nodes.where("shared").groupBy("a", "b").agg(
        *(F.max(c).alias(c) for c in ("depth", "up_a", "up_b", "n_bytes", "ends_sha256")),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    upper = cut(upper, "trie-upper")
    children = upper.where("up_a IS NOT NULL").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    upper = upper.join(children, ["a", "b"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("n", F.lit(0))).drop("n")
    upper = upper.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes"))
    upper = cut(_summed_up(cut(upper, "trie-merged")), "trie-summed")

    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")]
    names = broadcast_if(upper.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up_conv")))
    private = nodes.where("NOT shared")
    inside = private.where("up_a IS NULL").select(*told)
    under = private.where("up_a IS NOT NULL").drop("parent_conv_id").join(names, ["up_a", "up_b"]).withColumnRenamed("up_conv", "parent_conv_id")
    above = upper.join(names, ["up_a", "up_b"], "left").withColumnRenamed("up_conv", "parent_conv_id")
    return inside.union(under.select(*told)).union(above.select(*told))
