"""Queries against their SQL on rows that the given tables have not: nulls, empty texts, odd signs and blanks."""

import duckdb

from textquarry import plans

TEXTS = ("piano", "", None, "   ", "\n\n", "null", "a\u00a0b\u3000", "\u00a0x\u2028\u00a0", "a\x01b\x00", "x\x0by\x0cz\x1c", "cr\r\nlf\r", "<b>&amp; &lt; ]]> <!-- c -->", "\ufffe \uffff \U0001f600", "w" * 239 + " \u00a0 z", "w" * 239 + "\u00a0z", "y " * 300)
LABELS = ((None, "en"), ("", ""), (" src ", " en "), ("a&b<c", "<x>"), ("src1", None), ("null", "a@b.cd"), ("a,b", "(l)\n"))


def same(spark, tmp_path, names):
    rows = [(3 * i, t, "en", "src1", 1) for i, t in enumerate(TEXTS)] + [(100 + i, t, lang, source, 1) for i, (source, lang) in enumerate(LABELS) for t in ("testo", "")]
    rows += [(None, "senza numero", "en", "src0", 1), (-5, "meno", "en", "src1", 1), (7, "due", "de", "src2", 1), (7, "due", "de", "src2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in names:
        plans.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        want = con.sql(plans.ORACLE_SQL[name])
        got = con.sql(f"select {', '.join(want.columns)} from '{tmp_path}/{name}/*.parquet'")
        assert sorted(map(repr, got.fetchall())) == sorted(map(repr, want.fetchall())), name


def test_entries_of_feeds(spark, tmp_path):
    same(spark, tmp_path, ["fed1_normalize_entries", "src8_read_feed"])


def test_notices(spark, tmp_path):
    same(spark, tmp_path, ["sea20_hit_notice"])
