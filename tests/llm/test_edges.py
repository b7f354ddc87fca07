"""Awkward tables for every numbered operator and the pipeline, and queries of those that SQL cannot express against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import exact_dedup, jaccard, line_dedup, linear, media, mixing, packing, quality, queries, scoring, tokens, toxicity, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "uno due tre quattro cinque sei sette otto nove dieci undici dodici"


def rows():
    near = WORDS.split() * 4
    out = [(k, " ".join(w if j != k else "nuovo" for j, w in enumerate(near)), "it", "a", 1) for k in range(3)]
    out += [(10, "una riga ripetuta\nsola", "it", "a", 1), (11, "una riga ripetuta\naltra", "it", "b", 1)]
    out += [(None, "una riga ripetuta\nterza", "it", None, 1), (None, None, None, None, None), (None, WORDS, "it", "b", 1)]
    out += [(12, WORDS, "it", "b", 1), (12, WORDS, "it", "b", 1), (12, "tutt'altro testo", "it", "b", 1), (13, "", "it", "a", 1)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows alike, one id with two texts, null and empty texts."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(14)] + [(None, None, None), (12, 1, 1)], "doc_id long, quality int, toxic int")


def test_rows_alike_and_without_ids(odd):
    n = len(rows())
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    assert mixing.mix_sources(odd).count() == n
    assert tokens.token_counts(odd, word).count() == n
    assert tokens.token_counts(odd, word, huge=20, chunk=16, overlap=140).orderBy("n_bytes").select("n_tokens").collect() == tokens.token_counts(odd, word).orderBy("n_bytes").select("n_tokens").collect()
    assert scoring.backoff_scores(odd).count() == n
    assert packing.pack_sequences(odd, byte).where("start = 0").count() == n
    stored = media.read_media(media.store_media(odd)).collect()
    assert sorted(r["payload"] for r in stored) == sorted(media.payload_of((r[1] or "").encode()) for r in rows())


def test_exact_dedup_of_rows_alike(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = collections.defaultdict(list)
    for i, text, *_ in rows():
        groups["".join((text or "").split())].append((-len(text or ""), i is None, i))
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    for norm, members in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        own = [r for r in got if r["text_sha256"] == sha]
        assert kept[sha] == 1 and {r["keep_id"] for r in own} == {min(members)[2]} and {r["group_size"] for r in own} == {len(members)}


def test_lines_of_rows_alike(odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got if "sola" in r["text"] or "altra" in r["text"] or "terza" in r["text"]) == [(False, 10, "una riga ripetuta\nsola"), (False, 11, "altra"), (True, 0, "terza")]
    assert len(got) == len(rows())
    clash = odd.withColumn("__line_drop", F.lit(1)).withColumn("n_dropped", F.lit("x"))
    assert line_dedup.dedup_lines(clash).count() == len(rows())


def test_links_of_one_id_with_several_texts(spark):
    base = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["x"])), (2, " ".join(other)), (3, " ".join(other[:-1] + ["y"])), (None, " ".join(base[:-1] + ["z"])), (None, "solo nulli " * 9), (None, "solo nulli " * 9 + "qui")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (None, None)}
    kept = jaccard.near_duplicates_removed(table.union(table)).collect()
    assert [r["doc_id"] for r in kept if r["doc_id"] is not None] == [1]
    assert len(kept) == 2 or len(kept) == 3  # of the two texts without an id, one if they link


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    sets = []
    for n in (30, 900, 1100, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, np.unique(np.concatenate([base[: int(0.95 * n)], rng.integers(0, 1 << 63, n // 40, dtype=np.uint64)])), np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))]
    bits = jaccard.Bitmaps([jaccard.bitmap(s) for s in sets])
    n = np.array([len(s) for s in sets])
    i, j = np.array([(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and n[a] <= n[b] <= 1.25 * n[a]]).T
    near = bits.near(n, i, j, 80)
    for a, b, passed in zip(i, j, near, strict=True):
        assert passed or not jaccard.linked(sets[a], sets[b], 80)
    assert near.sum() < 0.6 * len(near)


def test_classifiers_on_odd_rows(odd, labels):
    assert toxicity.score_toxicity(odd, labels).count() == len(rows())
    assert quality.score_quality(odd, labels).count() == len(rows())
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    assert quality.score_quality(odd, labels.limit(0)).where("NOT kept").count() == 0
    assert linear.labelled_sample(odd, labels, {"toxic": F.col("toxic") > 0}, 4).count() <= 4


def plain_logistic(x, y, steps=4000, rate=0.5):
    """Gradient descent without a trick, with the same penalty."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ miss + w) / len(y), b - rate * miss.sum() / len(y)
    return w, b


def test_chain_against_a_plain_one():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (240, 4)).astype(float)
    first = (x[:, 0] + rng.random(240) > 1.0).astype(float)
    second = (x[:, 1] + first + rng.random(240) > 1.8).astype(float)
    links = toxicity.fit_chain(x, [first, second])
    w, b = plain_logistic(x, first)
    assert np.allclose(links[0][:-1], w, atol=0.08) and abs(links[0][-1] - b) < 0.08
    held = np.zeros(240)
    fold = np.arange(240) % toxicity.FOLDS
    for k in range(toxicity.FOLDS):
        own = plain_logistic(x[fold != k], first[fold != k])
        held[fold == k] = 1 / (1 + np.exp(-(x[fold == k] @ own[0] + own[1])))
    w, b = plain_logistic(np.column_stack([x, toxicity.logit(held)]), second, rate=0.1, steps=20000)
    ours = toxicity.chain_finish(["a", "b"], [links[0][4:], links[1][4:]], 0.5)(np.stack([x @ links[0][:4], x @ links[1][:4]], axis=1))
    p = 1 / (1 + np.exp(-(x @ links[0][:4] + links[0][-1])))
    want = 1 / (1 + np.exp(-(np.column_stack([x, toxicity.logit(p)]) @ w + b)))
    assert np.abs(ours["p_a"] - p).max() < 1e-6 and np.abs(ours["p_b"] - want).max() < 0.05


def test_ordinal_is_the_cumulative_link_optimum():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 3)).astype(float)
    grade = np.digitize(x @ np.array([2.0, 1.0, -1.0]) + rng.logistic(size=300), [0.0, 2.0])

    def loss(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = x @ w
        mass = 1 / (1 + np.exp(-(edges[grade + 1] - s))) - 1 / (1 + np.exp(-(edges[grade] - s)))
        return -np.log(mass).mean() + 0.5 * (w @ w) / 300

    w, t = quality.fit_ordinal(x, grade, 3)
    assert t[0] < t[1]
    best = loss(w, t)
    for k in range(5):  # no step in any direction is better
        for step in (-0.1, 0.1):
            v = np.concatenate([w, t])
            v[k] += step
            assert loss(v[:3], v[3:]) > best - 1e-4


def test_media_query(spark, odd, tmp_path):
    odd.where("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in queries.op5_media_columns(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(r)
    for i, text, *_ in rows():
        if i is None:
            continue
        raw = (text or "").encode()
        payload = media.payload_of(raw)
        files = webp.encode_many(media.frames_of(payload), media.text_code())
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum(map(len, files)), hashlib.sha256(b"".join(files)).hexdigest(), media.feature_of(media.frames_of(payload)))
        assert want in [tuple(r) for r in got[i]]


def test_media_choices():
    """Content decides what a file takes, and every choice comes back whole."""
    code = media.text_code()
    rng = np.random.default_rng(2)
    prose = " ".join("".join(rng.choice(list("aehinorstdl"), 1 + rng.integers(8))) for _ in range(900)).encode()
    text = np.frombuffer(prose[:2304], ">u4").astype(np.uint32).reshape(4, 144)
    noise = rng.integers(0, 1 << 32, (4, 144), dtype=np.uint32)
    ramp = np.cumsum(np.full((16, 144), 0x01010101, np.uint32), axis=0, dtype=np.uint32) + rng.integers(0, 1 << 32, (1, 144), dtype=np.uint32)
    fill = np.frombuffer(media.payload_of("breve".encode()), ">u4").astype(np.uint32).reshape(-1, 144)
    many = np.tile(rng.integers(0, 1 << 32, 400, dtype=np.uint32), 6)[: 16 * 144].reshape(16, 144)
    assert webp.choose(fill, code)[0] == (("palette",),)
    assert webp.choose(many, code)[1] == 6
    assert webp.choose(ramp, code)[0][0][0] == "predictor"
    assert webp.choose(text, code) is None
    images = [text, noise, ramp, fill, many]
    for image, back in zip(images, webp.decode_many(webp.encode_many(images, code)), strict=True):
        assert (image == back).all()


def test_bits_of_the_line_filter_do_not_matter(odd):
    few, many = (sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(odd, bits=b).collect()) for b in (1 << 16, 1 << 22))
    assert few == many


def test_empty_pipeline(spark, tmp_path, labels):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path, odd, labels):
    import corpus_pipeline

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} >= {0, 10, 11, None}
    assert math.fsum(p["length"] for p in pieces) > 0



def test_portions_follow_bytes_and_rows():
    texts = ["x" * n for n in (5, 1, 1, 20, 1, 1, 1, 1, 9)] + [None, ""]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = [p.column(1).to_pylist() for p in packing.portions(batch, most=3, size=10)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts) and len(parts) == 5


def test_many_rows_alike_are_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 2000)
    table = spark.createDataFrame([(1, "una riga che si ripete\nun'altra che resta")] * 400 + [(2, "una riga che si ripete")], "doc_id long, text string").repartition(4).cache()
    scores = {(r["doc_id"], round(r["log_score"], 6)) for r in scoring.backoff_scores(table).collect()}
    assert len(scores) == 2
    lines = [(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(table).collect()]
    assert sorted(lines) == [(1, 0)] * 400 + [(2, 1)]
