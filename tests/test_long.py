"""Queries against their SQL on texts and pages beyond any limit that the operators may set."""

import duckdb

from textquarry import plans


def same(spark, tmp_path, names, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    for name in names:
        plans.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        want = con.sql(plans.ORACLE_SQL[name])
        got = con.sql(f"select {', '.join(want.columns)} from '{tmp_path}/{name}/*.parquet'")
        assert sorted(map(repr, got.fetchall())) == sorted(map(repr, want.fetchall())), name


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "it", "src1", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


LONG = "\n".join(f"riga {i} di un testo lungo" for i in range(60_000)) + "\nthe end and the coda"


def test_articles(spark, tmp_path):
    assert len(LONG) > 1_500_000
    same(spark, tmp_path, ["fed11_search_articles"], documents=documents(spark, [LONG, "the and", "t\x01he and", "niente", "", None]))


def test_texts_of_entries(spark, tmp_path):
    same(spark, tmp_path, ["fed6_entry_text"], documents=documents(spark, [LONG, "a\x01b \ufffe & <b>", "  x\n\n y", "\n", "", None]))


def test_packaged(spark, tmp_path):
    """A word file, an open document, a book and a sheet of more paragraphs than a book's limit, and a book with a member above the limit of its size."""
    many, wide = "\n".join(f"riga {i}" for i in range(8_100)), "\n".join(["x" * 2_200_000] * 2)
    same(spark, tmp_path, ["src6_read_packaged_docs"], documents=documents(spark, [many, many, many, many, "uno", "due", "prima\n" + wide, "", "", None]))


def pages(spark, *bodies):
    return spark.createDataFrame([(i, f"https://p.example/{i}", f"<html><head><title>no</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")


PAGE = "".join(f"<p>riga {i} di una pagina lunga</p>" for i in range(45_000)) + "<h2>Titolo in fondo</h2><p>La coda della pagina</p>"
HEADS = "".join(f"<h{1 + i % 6}>Capitolo {i}</h{1 + i % 6}><p>testo</p>" for i in range(400))


def test_deep_links(spark, tmp_path):
    assert len(PAGE) > 1_500_000
    same(spark, tmp_path, ["web14_heading_deep_links"], pages=pages(spark, PAGE, HEADS, ""))


def test_lines_of_pages(spark, tmp_path):
    same(spark, tmp_path, ["web1_page_text"], pages=pages(spark, PAGE, HEADS, ""))


def test_headings_of_pages(spark, tmp_path):
    same(spark, tmp_path, ["web2_page_headings"], pages=pages(spark, PAGE, HEADS, ""))
    assert spark.read.parquet(f"{tmp_path}/web2_page_headings").count() == 401
