"""Work per page, document or word that crosses to Python, or to a regular expression, in bulk."""

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.operators import cleanup as K
from textquarry.operators import marks as M
from textquarry.operators import search as S
from textquarry.operators import structure as D


def test_a_page_goes_on_in_the_next_batch():
    page = [None, None, 1, 1, 1, 1, 1, 2]
    words = pa.RecordBatch.from_pydict({"page_id": pa.array(page, pa.int64()), "t": ["b", "a", " d ", "c", "", "f", "e", "g"], "x": [2.0, 1, 2, 1, 0, 2, 1, 1], "y": [0.0, 0, 0, 1, 0, 50, 50, 0], "h": pa.array([18.0] * 7 + [None])})
    want = [(None, 1, "a b"), (1, 1, "c d"), (1, 2, "e f"), (2, 1, "g")]
    for size in range(1, 9):
        parts = [words.slice(k, size) for k in range(0, 8, size)]
        assert [tuple(r.values()) for b in K._pages(iter(parts)) for r in b.to_pylist()] == want


def test_marks_are_taken_many_documents_at_once(spark):
    docs = spark.createDataFrame([(1, "uno\ndue\ntre" * 9), (2, "x")], "doc_key long, text string")
    marks = spark.createDataFrame([(1, "1", 0, "uno", "", None, "", True)], "doc_key long, id string, pos int, anchor string, prefix string, saved timestamp, excerpt string, is_resume boolean")
    new = docs.select("doc_key", F.explode(F.array(F.lit(3), F.lit(50))).alias("pos"), F.lit("2024-02-01").cast("timestamp").alias("saved")).where("doc_key = 1")
    found = M.add_marks(marks, new, docs)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    rows = found.orderBy("place").collect()
    assert [(r["id"], r["status"], r["saved"] is None) for r in rows] == [("1", "already", True), ("2", "added", False)]
    assert found.schema["saved"].dataType.simpleString() == "timestamp"


def test_only_lines_of_an_index_are_searched(spark):
    text = "long prose without dots\nUno ....\n 3\nDue\n\n  ... 4\nTre .. 5 .. 6\nmore. prose 7\nend"
    row = spark.range(1).select(F.lit(text).alias("text"), D.dotted(F.lit(text)).alias("left"))
    assert row.first()["left"] == "-\nUno ....\n 3\nDue\n\n  ... 4\nTre .. 5 .. 6\nmore. prose 7\n-"
    both = row.select(*[F.regexp_extract_all(c, F.lit(D.INDEX_LINE), F.lit(0)).alias(c) for c in ("text", "left")]).first()
    assert both["text"] == both["left"] and len(both["text"]) == 3


def test_words_are_folded_once_a_text(spark):
    docs = spark.createDataFrame([(1, "Caffè caffe CAFFÈ, tè"), (2, "niente")], "doc long, text string")
    rules = spark.createDataFrame([("caffe", "orzo", 1)], "find string, replace string, n int")
    held = S.with_glossary(docs, "text", rules, "n").orderBy("doc").select("mapping", S.apply_glossary(F.col("text"), F.col("mapping"), None).alias("after")).collect()
    assert held[0]["mapping"] == dict.fromkeys(["Caffè", "caffe", "CAFFÈ"], "orzo") and held[0]["after"] == "orzo orzo orzo, tè"
    assert held[1]["mapping"] is None
