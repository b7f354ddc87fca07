"""Queries whose words and entities are read as their SQL reads them."""

import duckdb
import pytest

from textquarry import plans
from textquarry.operators import pages as P
from textquarry.operators import search as S

CUT = "<html><head><title>Uno &quot;due&quot; &lt; ver&amp</title></head><body><h1>Uno ver&amp</h1><p>A &copy; b &amp; c</p></body></html>"


def agree(spark, d, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, d)
    columns = sorted(got.columns)
    want = con.sql(plans.ORACLE_SQL[name]).df()[columns].values.tolist()
    assert sorted(map(tuple, got.select(*columns).toPandas().values.tolist())) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["sea5_normalize_glossary", "sea6_apply_glossary", "sea7_match_with_glossary", "sea4_glossary_hits"])
def test_glossary_keeps_sharp_s(spark, tmp_path, name):
    spark.createDataFrame([(1, "Erßie the x"), (2, "that ent x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "erssie that", "a"), (2, "ERßIE that", "a"), (3, "erssie that the", "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, str(tmp_path), name, "benchmark", "documents")


def test_glossary_casefolds_by_itself(spark):
    rules = spark.createDataFrame([("Erßie", "x", 1)], "find string, replace string, n int")
    assert S.normalize_glossary(rules, "n").first()["key"] == "erssie"


@pytest.mark.parametrize("name", ["web1_page_text", "web2_page_headings", "web7_page_title", "web14_heading_deep_links"])
def test_entities_cut_off(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://a.example/", CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    agree(spark, str(tmp_path), name, "pages")


def test_entities_cut_off_by_themselves(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", CUT)], "page_id long, url string, html string")
    assert P.page_title(pages).first()["title"] == 'Uno "due" < ver&'
    assert P.page_headings(pages).first()["title"] == "Uno ver&"
