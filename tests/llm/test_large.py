"""Long texts and hot postings of the n-gram join, and line filters of many slices."""

import random


from textquarry.llm import jaccard, line_dedup
from textquarry.llm._words import shingle_sets


def plain_components(sets, percent=80):
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and jaccard.linked(sets[i], sets[j], percent):
                top[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_long_texts_that_share_much(spark):
    """Fourteen texts of up to 100,000 words over common boilerplate, some near copies: bitmaps stay short and travel once a task."""
    rng = random.Random(7)
    common = [f"c{k % 4000}" for k in range(30_000)]
    texts = []
    for k in range(7):
        own = [f"t{k}-{rng.randrange(10**6)}" for _ in range(70_000 - 9000 * k)]
        texts.append(common + own)
        texts.append(common + own[: int(len(own) * (0.97 if k % 2 else 0.6))] + [f"z{k}-{i}" for i in range(2000)])
    texts = [" ".join(t) for t in texts]
    sets = list(shingle_sets([t.encode() for t in texts], 5))
    assert max(map(len, sets)) > 70_000 and max(len(jaccard.bitmap(s)) for s in sets) == jaccard.MOST_BITMAP // 8
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    want = plain_components(sets)
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))} and 7 < len({*want}) < 14


def test_a_posting_of_many_rows_is_cut_into_blocks(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(150)] = f"x{rng.randrange(900)}"
        texts.append(" ".join(own))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = list(shingle_sets([t.encode() for t in texts], 5))
    want = plain_components(sets)
    for block in (3, 4096):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(table, block=block).collect()}
        assert got == dict(enumerate(want))


def test_units_hold_every_pair_once(spark):
    rows = spark.range(40).selectExpr("id % 2 AS token", "id AS node", "10 AS n", "0 AS pos", "id AS comp")
    bits = spark.range(40).selectExpr("id AS node", "encode(string(id), 'utf-8') AS bits")
    units = jaccard.dealt(rows, bits, 4, 6).collect()
    meets = {}
    for r in units:
        if r["bits"] is None:
            meets.setdefault(r["unit"], []).append((r["node"], r["role"]))
    pairs = [tuple(sorted((a, b))) for own in meets.values() for i, (a, x) in enumerate(own) for b, y in own[:i] if x == 2 or x != y]
    assert sorted(pairs) == sorted((a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2)
    held = [(r["slot"], r["node"]) for r in units if r["bits"] is not None]
    assert len(held) == len({*held}) and {*held} == {(r["slot"], r["node"]) for r in units if r["bits"] is None}


def test_filters_of_many_slices(spark, monkeypatch):
    """Slices and blocks of a few lines find what one large filter finds, and few lines are suspected without need."""
    rng = random.Random(11)
    docs = [(k, "\n".join(f"riga numero {rng.randrange(4000)} di prova" if rng.random() < 0.2 else f"riga sola {rng.random()}" for _ in range(30))) for k in range(300)] + [(7, "riga di due\nriga di due altre"), (None, "riga di due altre")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(table).collect())
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 40_000)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(table).collect()) == want
    rows = table.selectExpr("coalesce(doc_id, 9223372036854775807) AS line_doc", "xxhash64(text) AS line_text", "text")
    suspects = line_dedup.suspected_lines(rows, 10).count()
    lines = [x for _, t in docs for x in t.split("\n")]
    repeats = sum(lines.count(x) > 1 for x in lines)
    assert repeats <= suspects <= repeats + 0.05 * len(lines)
