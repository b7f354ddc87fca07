"""The numbered operators against plain versions, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textquarry.llm import exact_dedup, jaccard, line_dedup, media, mixing, packing, quality, scoring, tokens, toxicity, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.choice((3, 12, 80, 200)))
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 9 == 0:
            lines.insert(1, "  This is A shared Line ")
        if i % 7 == 0:
            lines.append(passage)
        rows.append((i, "\n".join(lines), "en", ["a", "b", "c", None][i % 4] if i % 3 else "hot", 0))
    base = rows[20][1].split(" ")
    for k in range(24):  # near copies of one text, in a chain
        base[(k * 7) % len(base)] = f"neu{k}"
        rows.append((200 + k, " ".join(base), "en", "hot", 0))
    rows += [(300 + k, rows[5][1], "en", "hot", 0) for k in range(30)]
    rows += [(400, None, None, None, None), (401, "", "x", "a", 0), (402, " \n\t ", "x", "a", 0), (403, "uno due", "x", "b", 0), (404, "UNO  due\n", "x", "b", 0), (405, "x" * 5000, "x", "c", 0)]
    rows += [(406, "\x00\x1c   é \U0001f600 <|endoftext|> 'll don't", "x", "c", 0), (407, "long " * 20000, "x", "hot", 0), (408, rows[5][1].replace(" ", "  "), "x", "a", 0)]
    return rows


ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column with a name that operators use themselves
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumn("n", F.lit(1)).withColumn("n_lines", F.lit("x")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def test_mixing(docs, empty):
    rows = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert len(rows) == len(ROWS)
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in ROWS}
    by_source = collections.Counter()
    for i, _, _, s, _ in ROWS:
        by_source[s] += sizes[i]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(by_source.values()))
    while True:  # share, stop those above, share the rest
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * by_source[s]}
        if not over:
            break
        target |= {s: 3.0 * by_source[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for i, _, _, s, _ in ROWS:
        r = rows[i]
        assert r["mix_size"] == sizes[i] and r["mix_source_size"] == by_source[s]
        assert r["mix_target"] == pytest.approx(target[s])
        assert 0 <= r["mix_copies"] <= 3
        taken[s] += r["mix_copies"] * sizes[i]
    for s in order:
        largest = max(sizes[i] for i, _, _, t, _ in ROWS if t == s)
        assert abs(taken[s] - target[s]) <= 1.5 * largest
    again = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert again == {i: r["mix_copies"] for i, r in rows.items()}
    assert mixing.emit_mix(docs).count() == sum(r["mix_copies"] for r in rows.values())
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"huge": 300, "chunk": 256, "overlap": 160}])
def test_token_counts(docs, empty, sizes):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, path, **sizes).collect()}
    for i, text, *_ in ROWS:
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 2048), i
    assert tokens.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("options", [{}, {"key_bits": 3, "capacity": 4}])
def test_exact_dedup(docs, empty, options):
    groups = collections.defaultdict(list)
    for i, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, **options).collect()}
    for norm, members in groups.items():
        for _, i in members:
            keep = min(members)[1]
            assert tuple(got[i])[:5] == (i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    repeated = docs.union(docs)
    assert exact_dedup.exact_dedup(repeated).where("kept").count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles(spark):
    keys = spark.range(1000).select(F.shiftright(F.shiftleft("id", 40), 0).alias("key"), F.lit(1).alias("n"))
    depths = {r["depth"] for r in exact_dedup.directory(keys, 300, 6).collect()}
    assert depths == {6}  # all keys share their leading bits: the bucket splits to the end and chains
    spread = spark.range(4096).select(F.shiftleft("id", 52).alias("key"), F.lit(1).alias("n"))
    assert {r["depth"] for r in exact_dedup.directory(spread, 300, 8).collect()} == {4}


def plain_components(rows, n=5, percent=80):
    sets = {}
    for i, text, *_ in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard(docs, empty, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == plain_components(ROWS)
    assert jaccard.jaccard_components(empty).count() == 0
    kept = {r["doc_id"] for r in jaccard.near_duplicates_removed(docs).collect()}
    assert kept == {c for i, (n, c) in plain_components(ROWS).items()}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    for few in (0, 20, 1 << 18):  # all by contraction, the rest by one task, all by it
        got = collections.defaultdict(set)
        for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), few).collect():
            got[r["comp"]].add(r["node"])
        assert sorted(map(sorted, got.values())) == [list(range(61)), [100, 200, 300]]


def test_line_dedup(docs, empty):
    first, seen = {}, collections.defaultdict(set)
    for i, text, *_ in ROWS:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
            if len(key) >= 10:
                seen[key].add(i)
    first = {k: min(v) for k, v in seen.items() if len(v) > 1}
    for bits in (None, 1 << 16):  # the small filters take most lines for suspects
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, bits=bits).collect()}
        for i, text, *_ in ROWS:
            lines = (text or "").split("\n")
            kept = [x for x in lines if first.get(x.strip(" \t\n\r\x0b\x0c").translate(LOWER), i) == i]
            assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    pieces = packing.pack_sequences(docs, path).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, text, *_ in ROWS:
        ids, at = np.array(own.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_sequences(empty, path).count() == 0


def test_packing_balances():
    rng = random.Random(2)
    lengths = [rng.randint(1, 2047) for _ in range(400)]
    cost = collections.Counter()
    for _, _, length, k, _ in packing.assign(lengths):
        cost[k] += length + length * length / 4096
    full = [c for k, c in cost.items() if k < sum(lengths) // 2048]
    assert max(full) / (sum(full) / len(full)) < 1.35


def random_image(rng, height, width, colours):
    palette = np.array([rng.getrandbits(32) for _ in range(colours)], np.uint32)
    return palette[np.array([[rng.randrange(colours) for _ in range(width)] for _ in range(height)])]


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 40, 250])
def test_webp_round_trips(colours):
    rng = random.Random(colours)
    image = random_image(rng, 11, 13, colours)
    modes = np.array([[rng.randrange(14) for _ in range(4)] for _ in range(3)])
    elements = np.array([[rng.getrandbits(32) for _ in range(4)] for _ in range(3)], np.uint32)
    for transforms in ((), (("green",),), (("palette",),), (("predictor", 2, modes),), (("cross", 2, elements),), (("predictor", 2, modes), ("cross", 2, elements), ("green",))):
        for cache, references in ((0, False), (4, False), (0, True), (7, True)):
            data = webp.encode(image, transforms, cache, references)
            assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8
            assert (webp.decode(data) == image).all(), (transforms, cache, references)
    # alike files and unlike ones side by side
    images = [random_image(rng, h, 6, 9) for h in (1, 5, 3, 5)]
    code = media.text_code()
    files = [*webp.encode_plain(images, code), webp.encode(image, (("palette",),)), *webp.encode_plain(images[:1], webp.code_lengths(np.arange(1, 257)))]
    for got, want in zip(webp.decode_many(files), [*images, image, images[0]], strict=True):
        assert (got == want).all()
        assert (webp.decode(files[0]) == images[0]).all()


def test_webp_damage():
    data = webp.encode_plain([np.zeros((4, 144), np.uint32)], media.text_code())[0]
    with pytest.raises(ValueError):
        webp.decode_many([data[:120]])
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 ")


def test_code_lengths():
    for counts in ([0, 0, 5], [1, 1], list(range(40)), [1 << k for k in range(30)]):
        lengths = webp.code_lengths(np.array(counts))
        used = lengths[lengths > 0]
        assert used.max() <= 15 and (len(used) == 1 or sum(2.0**-used) == 1)


def test_media(docs, empty):
    stored = media.store_media(docs)
    got = {r["doc_id"]: r for r in media.read_media(stored).collect()}
    for i, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[i]["payload"] == payload and got[i]["n_bytes"] == len(raw)
        assert b"".join(np.concatenate([webp.decode(f) for f in got[i]["media"]]).astype(">u4").tobytes() for _ in (0,)) == payload if i % 40 == 0 else True
    assert got[300]["media"] == got[5]["media"] and got[300]["feature"] == got[5]["feature"]
    assert media.read_media(media.store_media(empty)).count() == 0


def test_lm_scores(docs, empty):
    for order in (2, 3):
        grams = [collections.Counter() for _ in range(order + 1)]
        for _, text, *_ in ROWS:
            w = words_of(text)
            for k in range(1, order + 1):
                grams[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        total = sum(grams[1].values())

        def score(w, j):
            s = math.log(grams[1][w[j],] / total)
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(w[j - k + 1 : j + 1])
                s = math.log(grams[k][g] / grams[k - 1][g[:-1]]) if grams[k][g] >= 2 else math.log(0.4) + s
            return s

        got = {r["doc_id"]: r for r in scoring.backoff_scores(docs, order=order).collect()}
        for i, text, *_ in ROWS:
            w = words_of(text)
            assert got[i]["n_words"] == len(w)
            assert got[i]["log_score"] == pytest.approx(sum(score(w, j) for j in range(len(w))), rel=1e-9, abs=1e-9)
            assert (got[i]["mean_log_score"] is None) == (not w)
    assert scoring.backoff_scores(empty).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(9)
    names, seeds = [f"w{k}" for k in range(400)], [f"bad{k}" for k in range(10)]
    rows = []
    for i in range(900):
        words = rng.choices(names, k=rng.randint(5, 300))
        toxic, poor = i % 10 == 0, i % 10 in (3, 4)
        if toxic:
            for w in rng.sample(seeds, 3):
                words.insert(rng.randrange(len(words)), w)
        if poor:
            words = [w.upper() + "!!" for w in words for _ in range(3)]
        rows.append((i, " ".join(words), int(not poor), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()
    return table, table.where("doc_id % 3 <> 0").select("doc_id", "quality", "toxic")


def test_toxicity_held_out(spark, graded):
    table, labels = graded
    held = toxicity.score_toxicity(table, labels).where("doc_id % 3 = 0").select("doc_id", "toxic", "p_low_quality", "p_toxic").collect()
    truth = {r["doc_id"] for r in table.where("toxic = 1").select("doc_id").collect()}
    assert {r["doc_id"] for r in held if r["toxic"]} == {r["doc_id"] for r in held if r["doc_id"] in truth}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert toxicity.score_toxicity(odd, labels).count() == 3
    assert toxicity.score_toxicity(table.select("doc_id", "text"), labels.limit(0)).where("toxic").count() == 0
    assert toxicity.score_toxicity(table.limit(0), labels).count() == 0


def test_quality_held_out(graded):
    table, labels = graded
    scored = quality.score_quality(table.withColumnRenamed("quality", "truth").withColumnRenamed("toxic", "bad"), labels).where("doc_id % 3 = 0").collect()
    right = sum(r["kept"] == bool(r["truth"]) for r in scored)
    assert right >= 0.97 * len(scored)
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] for r in scored)
    mean = lambda keep: np.mean([r["expected_grade"] for r in scored if keep(r)])
    assert mean(lambda r: r["truth"] == 0) < mean(lambda r: r["bad"] == 1) < mean(lambda r: r["truth"] == 1 and r["bad"] == 0)


def test_pipeline(spark, tmp_path, graded):
    import corpus_pipeline

    table, labels = graded
    rows = [r for r in ROWS if r[1]]
    spark.createDataFrame(rows, SCHEMA).unionByName(table.selectExpr("doc_id + 1000 AS doc_id", "text", "'en' AS lang", "'t' AS source", "0L AS n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in docs.select("doc_id").collect()}
            assert gone == {1000 + i for i in range(900) if i % 10 == 0}
        if name == "n-gram Jaccard join":
            ids = jaccard.jaccard_components(before.select("doc_id", "text"))
            assert docs.count() == ids.select("component_id").distinct().count()
    assert docs.agg(F.sum("length")).first()[0] > 0
