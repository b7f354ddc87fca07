"""Spelling variants against a plain version, with blocks that many words share, and odd rows."""

import collections
import random
import re
import zlib

import pytest

from textquarry.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, letters=6, least=5, ratio=5, slip=199):
    """Every word against every word."""
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= letters
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return sorted(rows)


def told(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_variants_against_plain_ones(spark, block):
    rng = random.Random(4)
    bases = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["comune" + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    docs = []
    for k in range(400):
        words = []
        for base in rng.choices(bases, [1 / (i % 40 + 1) for i in range(80)], k=30):
            at, kind = rng.randrange(len(base)), rng.random()
            words.append(base if kind < 0.6 else base[:at] + base[at + 1 :] if kind < 0.75 else base[:at] + "b" + base[at:] if kind < 0.9 else base[:at].upper() + "é" + base[at + 1 :])
        docs.append((k, "1 ".join(words)))
    want = plain(docs, slip=7)
    assert any(r[1] and r[2] != r[1] for r in want) and len(want) > 100
    assert told(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), slip=7, block=block)) == want


def test_query_against_plain_variants(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")) == plain(docs)


def test_odd_documents(spark):
    long = "abcde" * 4000
    docs = [(None, "parola Parola parola, parolä parolà"), (1, None), (2, ""), (3, "parola " * 9), (3, "parola " * 9), (4, "parolo " * 5), (5, "brevi " * 9)]
    docs += [(10 + k, f"{long} {long[:-1]}x {'q' * 70} {'q' * 71}") for k in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    assert told(spelling.spelling_variants(table)) == plain(docs, slip=None)
    assert told(spelling.spelling_variants(table.limit(0))) == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(table, ratio=1)
