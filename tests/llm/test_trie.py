"""The conversation trie against a plain one, its double array, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import conversation_trie as trie
from textquarry.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own.setdefault(conv, []).append((role, text))
    members, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        seq = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(conv)
        ends.setdefault(seq, []).append(conv)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node], sha(ends.get(node, []))) for node, m in members.items())


def told(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def talks(seed, n=160):
    """Conversations that share first turns to any depth, with copies, long ones and gaps in the ids."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        if rng.random() < 0.15:
            continue
        kind = rng.random()
        length = rng.choice([1, 2, 3, 6, 9, 12, 30])
        seq = [("u" if k % 2 else None, f"tè {k}" if kind < 0.5 or k < length - 2 and kind < 0.8 else f"{rng.randrange(4)}") for k in range(length)]
        rows += [(conv, None if k == 0 and kind < 0.3 else k, role, text) for k, (role, text) in enumerate(seq)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns,sequences", [(1 << 16, 1024), (40, 2), (1, 0)])
def test_nodes_against_plain_ones(spark, turns, sequences):
    rows = talks(turns)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("x")).repartition(5)
    assert told(trie.conversation_trie(table, most_turns=turns, most_sequences=sequences)) == plain(rows)


def test_query_against_plain_nodes(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.001")) == plain(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "u", "di nessuno"), (3, None, None, None), (3, 1, "u", "ß\u0000è"), (8, 0, "u", ""), (8, 0, "u", ""), (-7, 0, "u", "prima"), (-6, 0, "u", "poi"), (40, 0, "m", "x" * 200000)]
    assert told(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert told(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    assert told(trie.conversation_trie(spark.createDataFrame(rows[:1], SCHEMA))) == []


def test_ends_in_pieces(spark, monkeypatch):
    convs = spark.range(5000).selectExpr("id % 3 AS a", "7L AS b", "id * 37 % 5000 AS conv_id")
    monkeypatch.setattr(trie, "PIECE", 100)
    got = {r["a"]: r["ends"] for r in trie.ends(convs).collect()}
    ids = [(i % 3, i * 37 % 5000) for i in range(5000)]
    assert got == {k: hashlib.sha256(",".join(str(c) for c in sorted(c for a, c in ids if a == k)).encode()).hexdigest() for k in range(3)}


def test_double_array_holds_every_sequence():
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 40, rng.integers(0, 9)) for _ in range(500)]
    counts = np.array([len(s) for s in sequences])
    keys = np.concatenate(sequences)
    array, dense = trie.pack(keys, np.cumsum(counts) - counts, counts)
    seen = {}
    for s in sequences:
        state = np.zeros(1, np.int64)
        for d, key in enumerate(s.tolist()):
            state = array.step(state, dense[[key]])
            assert seen.setdefault(int(state[0]), tuple(s[: d + 1].tolist())) == tuple(s[: d + 1].tolist())
    assert len(seen) == len({tuple(s[: d + 1].tolist()) for s in sequences for d in range(len(s))})
    with pytest.raises((ValueError, IndexError)):
        array.step(np.array([max(seen)]), np.array([10**6]))
