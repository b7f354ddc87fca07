"""Comparing, transcripts, marks and conversations on literal rows."""

import datetime

from pyspark.sql import functions as F

from textquarry.operators import compare as C
from textquarry.operators import conversations as V
from textquarry.operators import marks as M
from textquarry.operators import transcripts as T

TEXT = "Copertina\n\nCapitolo uno. La fisica dei quanti inizia qui.\nNel mezzo del libro c'è un altro punto.\nFine.\n"


def test_compare(spark):
    docs = spark.createDataFrame([(1, 1, "Uno. Due vale 3.5 euro. Tre."), (1, 2, "Uno. Due vale 4 euro. Tre."), (1, 3, None)], "grp int, doc int, text string")
    exploded = C.explode_clauses(docs, ["grp", "doc"])
    assert {r["clause"] for r in C.common_clauses(exploded, "grp", "doc").collect()} == {"Uno.", "Tre."}
    differences = C.text_differences(exploded, "grp", "doc")
    assert {(r["doc"], r["clause"]) for r in differences.collect()} == {(1, "Due vale 3.5 euro."), (2, "Due vale 4 euro.")}
    assert C.comparison_summary(docs, differences, exploded, "grp", "doc").first()["differing"] == 3


def test_texts_are_cut_into_clauses_once_for_what_is_counted(spark):
    from textquarry import plans

    docs = spark.createDataFrame([(1, 1, "Uno. Due. Tre. Due."), (1, 2, "Uno. Quattro."), (1, 3, None), (2, 4, "Solo.")], "grp int, doc int, text string")
    places = C.clause_places(C.explode_clauses(docs, ["grp", "doc"]), "grp", "doc")
    shown = C.difference_places(places, "grp", "doc", 1)
    assert {(r["doc"], r["pos"], r["n"], r["hidden"]) for r in shown.collect()} == {(1, 1, 1, 1), (2, 1, 1, 0)}
    summary = C.comparison_summary(docs, shown, places, "grp", "doc")
    assert {(r["grp"], r["n_files"], r["differing"], r["hidden"], r["coincide"]) for r in summary.collect()} == {(1, 3, 3, 1, False), (2, 1, 0, 0, True)}
    cut = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Generate")
    assert (cut("cmp5_comparison_summary"), cut("cmp3_text_differences")) == (0, 1)


def test_envelope(spark):
    docs = spark.createDataFrame([(1, "Docusign Envelope ID: 0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9 Testo.")], "doc int, text string")
    rows = [r["clause"] for r in C.explode_clauses(docs, ["doc"]).orderBy("pos").collect()]
    assert rows == ["Docusign Envelope ID: 0A1B2C3D-4E5F-6071-8293-A4B5C6D7E8F9", "Testo."]


def test_facts(spark):
    rows = spark.createDataFrame([(1, 1, "Video MP4", "3 s"), (1, 2, "Video MP4", None)], "grp int, doc int, kind string, length string")
    out = C.fact_differences(rows, "grp", "doc", {"kind": "Tipo", "length": "Durata"}, optional="Durata").collect()
    assert {(r["doc"], r["fact"], r["value"]) for r in out} == {(1, "Durata", "3 s"), (2, "Durata", "non disponibile")}


def test_chunks(spark):
    timed = "\n".join(f"[00:{i:02d}] " + "x" * 20 for i in range(30))
    docs = spark.createDataFrame([(1, timed), (2, "a" * 450 + "\n\nb\n\nc"), (3, "  ")], "doc int, text string")
    rows = T.chunk_text(docs, "doc", max_chars=200).orderBy("doc", "pos").collect()
    assert "\n".join(r["chunk"] for r in rows if r["doc"] == 1) == timed
    assert [len(r["chunk"]) for r in rows if r["doc"] == 2] == [200, 200, 50, 4]
    assert not [r for r in rows if r["doc"] == 3]


def test_map_chunks(spark):
    def cut(text):
        return (text.upper(), "MAX_TOKENS" if len(text) > 80 else "STOP", "")

    def fail(text):
        return ("", "", "rotto") if "no" in text else (text, "STOP", "")

    chunks = spark.createDataFrame([(1, 0, "riga uno\n" * 60)], "doc int, pos int, chunk string")
    assert T.map_chunks(chunks, "doc", cut, least=50).first()["text"].replace("\n", "") == "RIGA UNO" * 60
    broken = spark.createDataFrame([(1, 0, "si"), (1, 1, "no"), (1, 2, "dopo")], "doc int, pos int, chunk string")
    assert tuple(T.map_chunks(broken, "doc", fail).first()) == (1, "si", "rotto")


def test_sections(spark):
    text = "=== Riassunto accessibile ===\nBreve\n\n=== Trascrizione (con timestamp) ===\n[00:01] a\n[00:43] b\n"
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    assert [(r["title"], r["body"]) for r in T.split_sections(docs, "doc").orderBy("pos").collect()] == [("Riassunto accessibile", "Breve"), ("Trascrizione (con timestamp)", "[00:01] a\n[00:43] b")]
    portion = docs.select(T.portion_to_map(F.col("text")).alias("p")).first()["p"]
    assert portion["body"] == "[00:01] a\n[00:43] b"
    assert "Breve" not in docs.select(T.strip_section(F.col("text"), "Riassunto")).first()[0]


def test_quotas_and_forms(spark):
    files = spark.createDataFrame([("f", f"{i}", 10.0) for i in range(7)] + [("f", "x", 1260.0), ("f", "y", 0.0), ("f", "z", None)], "folder string, path string, duration_sec double")
    states = {r["path"]: r["status"] for r in T.apply_quotas(files, "folder", "path").collect()}
    assert [states[str(i)] for i in range(7)] == ["kept"] * 5 + ["over_limit"] * 2
    assert (states["x"], states["y"], states["z"]) == ("too_long", "unknown", "unknown")


def test_clip(spark):
    segments = spark.createDataFrame([(5.0, None, 20.0, 60.0), (25.0, None, 20.0, 60.0), (5.0, 30.0, 20.0, 60.0)], "sec double, a double, b double, d double")
    kept = T.clip_segments(segments, "a", "b", "d", "keep").collect()
    assert [(r["sec"], r["error"]) for r in kept] == [(5.0, None), (5.0, "end before start")]


def test_pairs(spark):
    media = spark.createDataFrame([("m/clip_locale.mp4",), ("m/senza.mp3",)], "path string")
    reports = spark.createDataFrame([("m/clip_locale.report.txt", "x"), ("m/solo_report.report.txt", "y")], "path string, text string")
    rows = {(r["media_path"], r["report_path"]) for r in T.pair_media_reports(media, reports).collect()}
    assert rows == {("m/clip_locale.mp4", "m/clip_locale.report.txt"), ("m/senza.mp3", None), (None, "m/solo_report.report.txt")}


def test_marks(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc_key string, text string")
    at = TEXT.index("La fisica")
    now = datetime.datetime(2024, 1, 1)
    mark = [("d", "1", at, TEXT[at : at + 80], TEXT[at - 40 : at] if at > 40 else TEXT[:at], now, "", True)]
    marks = spark.createDataFrame(mark, "doc_key string, id string, pos int, anchor string, prefix string, saved timestamp, excerpt string, is_resume boolean")
    assert tuple(M.resolve_marks(marks, docs).select("place", "outcome").first()) == (at, "exact")
    moved = docs.withColumn("text", F.concat(F.lit("Nuovo.\n"), "text"))
    assert tuple(M.resolve_marks(marks, moved).select("place", "outcome").first()) == (at + 7, "found")
    gone = docs.withColumn("text", F.lit("corto"))
    assert tuple(M.resolve_marks(marks, gone).select("place", "outcome").first()) == (5, "nearest")
    new = spark.createDataFrame([("d", TEXT.index("Nel mezzo"), now), ("d", at + 8, now + datetime.timedelta(1))], "doc_key string, pos int, saved timestamp")
    rows = sorted((r["id"], r["status"], r["is_resume"]) for r in M.add_marks(marks, new, docs).collect())
    assert rows == [("1", "already", True), ("2", "added", False)]
    assert M.merge_marks(marks, marks).count() == 1


def test_links_and_lists(spark):
    text = "Vedi [NASA](https://www.nasa.gov/x).\n- nasa.gov: https://vertexaisearch.example/grounding-api-redirect/ABC\n- esa.int: https://www.esa.int/Euclid"
    turns = spark.createDataFrame([(1, 0, "model", text)], "conv_id int, turn int, role string, text string")
    links = {r["url"]: r["label"] for r in V.extract_links(turns).collect()}
    assert len(links) == 3 and links["https://vertexaisearch.example/grounding-api-redirect/ABC"] == "nasa.gov"
    assert V.last_turns(turns.union(spark.createDataFrame([(1, 1, "user", " ")], turns.schema)), 1).count() == 0


def test_merge_stores(spark):
    a = spark.createDataFrame([("k", "1"), ("o", "1")], "key string, digest string")
    b = spark.createDataFrame([("k", "2"), ("n", "3")], "key string, digest string")
    rows = {(r["key"], r["digest"]) for r in V.merge_stores(a, b).collect()}
    assert rows == {("k", "1"), ("k__altra-copia", "2"), ("o", "1"), ("n", "3")}
    base = spark.createDataFrame([("k", "1")], "key string, digest string")
    assert {(r["key"], r["digest"]) for r in V.merge_stores(a, b, base).collect()} == {("k", "2"), ("o", "1"), ("n", "3")}


def test_search_summary(spark):
    from textquarry.operators.incremental import search_summary

    media = spark.createDataFrame([("m/clip_locale.mp4",), ("m/senza_sidecar.mp3",)], "path string")
    reports = spark.createDataFrame([("m/clip_locale.report.txt", "Scheda\n[00:12] gol di cross dalla destra\n")], "path string, text string")
    hits = reports.where(F.col("text").contains("cross")).select(F.col("path").alias("report_path"))
    assert tuple(search_summary(media, T.pair_media_reports(media, reports), hits, max_new=0).first()) == (2, 1, 0, 1)
    orphan = spark.createDataFrame([("m/solo_report.report.txt", "[00:05] Pronto al cross, si muove\n")], "path string, text string")
    hits = orphan.select(F.col("path").alias("report_path"))
    assert tuple(search_summary(media.limit(0), T.pair_media_reports(media.limit(0), orphan), hits).first()) == (0, 1, 0, 0)
