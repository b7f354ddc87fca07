"""Sketches against the similarity they estimate, components against all pairs, large groups in small blocks, and odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import sketching
from textquarry.llm._words import U


def shingles(text, n=3):
    words = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    return {words[k : k + n] for k in range(len(words) - n + 1)} if len(words) >= n else {words} if words else set()


def plain(docs, percent=85):
    """doc_id, n_shingles, component_id, kept by all pairs."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[i][0] == docs[j][0] and sets[i] and sets[j] or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i]:
                top[root(i)] = root(j)
    rows = []
    for k, (doc, _) in enumerate(docs):
        own = [docs[i][0] for i in range(len(docs)) if sets[k] and root(i) == root(k) and docs[i][0] is not None]
        component = min(own, default=None) if sets[k] else doc
        rows.append((doc, len(sets[k]), component, doc == component))
    return sorted(rows, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(seed, groups, members, words, changes):
    """Texts that differ from their group's in up to `changes` words, and so from one another in up to twice as many."""
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(words)] = f"x{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    return [(k * 7 % 10007, t.upper() if k % 3 == 0 else t) for k, (_, t) in enumerate(docs)]


def test_every_coordinate_fills_and_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for n, share in ((1, 1.0), (7, 0.7), (60, 0.5), (400, 0.85), (5000, 0.3)):
        misses = []
        for _ in range(40):
            own = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            cut = round(n * share)
            a, b = np.unique(own[:n]), np.unique(np.concatenate([own[:cut], own[n : 2 * n - cut]]))
            found = sketching.sketches([a, b, np.empty(0, U)])
            assert (found[:2] != ~U(0)).all() and (found[2] == ~U(0)).all()
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            misses.append((found[0] == found[1]).mean() - real)
        assert abs(np.mean(misses)) < 0.03 and np.abs(misses).max() < 0.25
    keys = sketching.band_keys(sketching.sketches([a, a, b]))
    assert (keys[0] == keys[1]).all() and len(np.unique(keys[0])) == 32


@pytest.mark.parametrize("block", [4096, 3])
def test_components_against_all_pairs(spark, block):
    docs = copies(1, 12, 9, 120, 5) + [(20000 + k, t) for k, (_, t) in enumerate(copies(2, 1, 60, 90, 3))] + [(30000 + k, f"corto {k % 4}") for k in range(12)]
    want = plain(docs)
    assert 20 < len({r[2] for r in want}) < len(docs) - 60  # links hold and fail within groups
    assert told(sketching.sketch_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block=block)) == want


def test_odd_documents(spark):
    base = [f"w{k}" for k in range(80)]
    other = [f"v{k}" for k in range(80)]
    docs = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (2, " ".join(other)), (3, " ".join([*other[:-1], "y"])), (4, None), (5, ""), (6, " \n\t"), (7, "sola"), (8, "Sola"), (8, "Sola")]
    docs += [(None, " ".join([*base[:-1], "z"])), (None, "senza nome " * 9), (None, None), (9, "lungo " * 300000), (10, "lungo " * 300001)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("bits", F.lit(1))
    assert told(sketching.sketch_components(table)) == plain(docs)
    assert told(sketching.sketch_components(table.limit(0))) == []
