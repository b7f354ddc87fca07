"""Search operators on literal rows."""

from pyspark.sql import functions as F

from textquarry.functions.text import clip_words, nth_position, parse_clock, clock_error, size_label
from textquarry.operators import search as S
from textquarry.operators.cleanup import best_candidate, match_ocr_tolerant, reading_order, reflow_vertical


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_line_hits_keep_blank_lines(spark):
    docs = spark.createDataFrame([("a.zip", "a.txt", "uno\n\ndue gol\n\ntre")], "archive string, member string, text string")
    hit = S.line_hits(docs, "archive", "member", ["gol"]).first()
    assert (hit["line_number"], hit["snippet"]) == (3, "uno  due gol  tre")
    assert S.line_hits(docs, "archive", "member", []).count() == 0


def test_line_hits_cap_per_archive(spark):
    docs = spark.createDataFrame([("z", i, "gol") for i in range(60)], "archive string, member int, text string")
    assert {r["member"] for r in S.line_hits(docs, "archive", "member", ["GOL"]).collect()} == set(range(40))


def test_transcript_hits(spark):
    report = spark.createDataFrame([("r", "Scheda\n[00:12] gol di cross dalla destra\n\nfine cross\n")], "doc string, text string")
    hits = S.transcript_hits(report, "doc", ["cross"]).orderBy("line_number").collect()
    assert [(h["line_number"], h["timestamp"], h["location_label"]) for h in hits] == [(2, "00:12", "Trascrizione [00:12]"), (4, "00:12", "Trascrizione [00:12]")]
    assert hits[0]["snippet"] == "Scheda [00:12] gol di cross dalla destra fine cross"


def test_glossary(spark):
    rules = spark.createDataFrame([(1, "Almqvist", "Alajbegović"), (2, "Vlahovic", "Woltemade"), (3, "vlahović", "no"), (4, "", "x")], "n int, find string, replace string")
    mapping = S.glossary_map(rules, "n")
    fixed = lambda t: one(spark, S.apply_glossary(F.lit(t), mapping))
    assert fixed("parla di Almqvist qui") == "parla di Alajbegović qui"
    assert fixed("Almqvistian resta") == "Almqvistian resta"
    assert fixed("Vlahović, VLAHOVIC") == "Woltemade, Woltemade"
    assert S.normalize_glossary(rules, "n").count() == 2


def test_tolerant_match(spark):
    texts = spark.createDataFrame([(1, "SQUAD ST"), (2, "B1RTHDAY"), (3, "buon compleanno"), (4, "niente")], "id int, text string")
    found = lambda *t: {r["id"] for r in match_ocr_tolerant(texts, "text", list(t)).collect()}
    assert found("squadlist") == {1}
    assert found("birthday") == {2, 3}
    assert found("squad", "xyzzy") == set()
    assert found() == set()


def test_reading_order(spark):
    words = [("Canale", 12, 9), ("Programma", 234, 14), ("Orario", 403, 16), ("Durata", 553, 17), ("LA7", 1, 50), ("Film", 200, 51), ("21:10", 400, 52)]
    boxes = spark.createDataFrame([(1, t, float(x), float(y), 50.0, 18.0) for t, x, y in words], "page_id long, t string, x double, y double, w double, h double")
    assert [r["line"] for r in reading_order(boxes).orderBy("line_no").collect()] == ["Canale Programma Orario Durata", "LA7 Film 21:10"]


def test_reflow(spark):
    assert one(spark, reflow_vertical(F.lit("C\nI\nA\nO"))) == "CIAO"
    assert one(spark, reflow_vertical(F.lit("Una riga\naltra"))) == "Una riga\naltra"


def test_best_candidate(spark):
    rows = spark.createDataFrame([(1, "Buona sera"), (1, "buona sera a tutti"), (1, "###")], "item int, text string")
    assert best_candidate(rows, "item", []).first()["text"] in ("buona sera a tutti", "buona sera a tutti\n###")


def test_small_functions(spark):
    assert one(spark, size_label(F.lit(1536))) == "1,5 KB"
    assert one(spark, size_label(F.lit(None).cast("long"))) == "0 byte"
    assert one(spark, nth_position(F.lit("aaaa"), F.lit("aa"), 3)) == 2
    assert one(spark, nth_position(F.lit("aaaa"), F.lit("aa"), 4)) == -1
    assert one(spark, clip_words(F.lit("a" * 25 + " " + "b" * 25), 40)) == "a" * 25
    assert [one(spark, parse_clock(F.lit(t))) for t in ("1:20", "01:20:50", " ", "7,5", "x")] == [80.0, 4850.0, None, 7.5, None]
    assert [one(spark, clock_error(F.lit(t))) for t in ("x", "", "3")] == [True, False, False]


def test_hit_notice(spark):
    assert one(spark, S.hit_notice(F.lit("riga 3"), F.lit(""))) == "Punto della ricerca: riga 3."
    assert one(spark, S.hit_notice(F.lit(None).cast("string"), F.lit("x" * 300))) == "Estratto della ricerca: " + "x" * 240 + "…"


def test_merge_profiles_again_changes_nothing(spark):
    cols = "name string, path string, query string, filter_mode int, custom_ext string"
    base = spark.createDataFrame([("a", "p", "q", 0, "")], cols)
    extra = spark.createDataFrame([("A", "p2", "q", 0, ""), ("b", "p", "q", 0, "")], cols)
    merged = S.merge_profiles(base, extra)
    assert {r["name"] for r in merged.collect()} == {"a", "A, altra copia"}
    assert S.merge_profiles(merged, extra).count() == 2


def test_hits_in_long_documents(spark):
    """The text is split once, so that 16,000 lines take a moment, and None lifts the number of hits."""
    import time

    from textquarry.streaming import arrivals as A

    def long(n, word):
        return spark.createDataFrame([("a", 1, "\n".join(f"{word} riga {k}" for k in range(n)))], "archive string, member int, text string").cache()

    none, every = long(16_000, "altra"), long(16_000, "zeta")
    for docs in (none, every):
        docs.count()
    S.line_hits(every, "archive", "member", ["zeta"]).collect()
    start = time.perf_counter()
    assert S.line_hits(none, "archive", "member", ["altra", "15999"]).first()["line_number"] == 16_000
    assert S.line_hits(none, "archive", "member", ["15998", "15999"]).count() == 0
    assert [r["line_number"] for r in A.search_arrivals(every, ["zeta"], ["member"]).collect()] == [1]
    assert S.line_hits(none, "archive", "member", ["zeta"]).count() == 0
    assert time.perf_counter() - start < 6
    assert S.transcript_hits(every, "member", ["zeta"], max_hits=None).count() == 16_000
    assert S.transcript_hits(every, "member", ["zeta"]).count() == 30
    many = spark.range(100).selectExpr("'a' AS archive", "id AS member", "'zeta' AS text")
    assert S.line_hits(many, "archive", "member", ["zeta"], max_hits=None).count() == 100
    assert S.line_hits(many, "archive", "member", ["zeta"]).count() == 40


def test_transcripts_with_a_glossary(spark):
    docs = spark.createDataFrame([(1, "[00:01] Parla Vlahović\n\n bene"), (2, "[00:02] Woltemade solo")], "doc int, text string")
    rules = spark.createDataFrame([(1, "vlahovic", "Woltemade")], "n int, find string, replace string")
    hits = S.transcript_hits(S.with_glossary(docs, "text", rules, "n"), "doc", ["woltemade"], glossary_col="mapping").orderBy("doc").collect()
    assert [(r["snippet"], r["location_label"]) for r in hits] == [("[00:01] Parla Woltemade bene", "Trascrizione [00:01] (glossario)"), ("[00:02] Woltemade solo", "Trascrizione [00:02]")]


def test_profiles_by_folder_kind_and_extension(spark):
    docs = spark.createDataFrame([(1, "/r/a/uno.TXT", "parola zeta", "it"), (2, "/r/a/due.pdf", "parola", "it"), (3, "/r/ab/tre.mp3", None, "it"), (4, "/r/a/b/quattro.txt", "zeta", "en")], "doc_id int, path string, text string, lang string")
    schema = "name string, terms array<string>, profile_path string, profile_kind string, profile_ext string"
    rows = [("tutto", ["parola"], None, None, None), ("txt", ["ZETA"], "/r/a/", None, "*.txt; md"), ("audio", [], None, "audio", None), ("cartella", None, "/r/a", None, "*"), ("pdf", [], "/r/", "document", "PDF"), ("nulla", [], None, None, ""), ("fuori", ["parola"], "/x", None, None)]
    got = sorted((r["name"], r["doc_id"]) for r in S.run_profiles(docs, spark.createDataFrame(rows, schema), path_col="path").collect())
    assert got == [("audio", 3), ("cartella", 1), ("cartella", 2), ("cartella", 4), ("pdf", 2), ("tutto", 1), ("tutto", 2), ("txt", 1), ("txt", 4)]


def test_strings_of_any_kind_in_texts(monkeypatch):
    """Pieces, portions and rows end anywhere: the strings found are those of a plain search."""
    import random

    import pyarrow as pa

    from textquarry.operators import strings as K

    rng = random.Random(25)
    for _ in range(200):
        for name, sizes in (("PIECE", (1, 3, 64, 1 << 18)), ("PAIRS", (1, 5, 1 << 20)), ("CELLS", (0, 1 << 22)), ("WEIGHT", (1, 50, 4 << 20))):
            monkeypatch.setattr(K, name, rng.choice(sizes))
        signs = rng.choice(["a", "ab", "abcé", "\0aß"])
        strings = sorted({"".join(rng.choices(signs, k=rng.choice([1, 2, 3, 4, 5, 9, 10, 15, 16, 17, 40]))) for _ in range(rng.randint(0, 30))})
        texts = [rng.choice([None, "", "".join(rng.choices(signs, k=rng.randint(0, 80)))]) for _ in range(rng.randint(0, 9))]
        got, at, known = [], 0, K.Strings(pa.array(strings, pa.string()))
        for part in K._portions(pa.array([None, *texts], pa.string()).slice(1)):
            row, own = known.held(part)
            got += [(at + i, strings[j]) for i, j in zip(row.tolist(), own.tolist(), strict=True)]
            at += len(part)
        assert at == len(texts)
        assert got == [(i, s) for i, t in enumerate(texts) for s in strings if t and s in t]


def test_profiles_are_met_where_the_documents_are(spark, tmp_path):
    """Documents, copies among them, meet their profiles without a shuffle, and a text is searched once a pass."""
    docs = [(i, "it" if i % 2 else None, t) for i, t in enumerate(["Uno due tre", "uno due tre", "uno due tre", "DUE", "", None, "e la strada che porta alla città", "una strada qualunque, é"])]
    spark.createDataFrame(docs, "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/docs")
    asked = [("a", ["uno", "TRE"], None), ("b", ["due"], "it"), ("c", ["e", "", "strada che porta alla città"], None), ("d", ["manca", "uno"], None), ("e", ["É", "una strada qualunque"], None), ("f", [""], None), ("g", None, None)]
    profiles = spark.createDataFrame(asked, "name string, terms array<string>, profile_lang string")
    want = {(n, i) for n, terms, own in asked for i, lang, t in docs if t and any(terms or []) and all(x.lower() in t.lower() for x in terms) and own in (None, lang)}
    for most in (1, 3, 1000):
        found = S.run_profiles(spark.read.parquet(f"{tmp_path}/docs"), profiles, most=most)
        rows = [(r["name"], r["doc_id"]) for r in found.collect()]
        assert len(rows) == len(want) and {*rows} == want
    plan = found.select("name", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("ArrowEvalPython") == 1
