"""Page, structure and address operators on literal rows."""

from pyspark.sql import functions as F

from textquarry.functions import urls as U
from textquarry.operators import pages as P
from textquarry.operators import structure as D

BASE = "https://example.com/libro/pagina.html"
PAGE = """<html><head><title>Prova &amp; pagina</title><style>p{}</style></head><body><script>var x="<p>";</script>
<h1 id="inizio">Capitolo uno</h1><p>Citt&#224; <a href="#fine">vai</a></p><p id="nota">Una nota<p>Altra <a href="altra.html">pagina</a>
<a href="https://www.esempio.org/x">fuori</a> <a href="javascript:void(0)">no</a> <a href="file:///c:/x.txt">file</a> <a href="mailto:a@b.it">posta</a></p>
<h2 id="fine">Fine</h2><h3>Stessa</h3><p>mezzo</p><h3>Stessa</h3></body></html>"""


def pages(spark, html=PAGE, url=BASE):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_headings(spark):
    heads = P.page_headings(pages(spark)).orderBy("pos").collect()
    assert [(h["level"], h["title"], h["occ"], h["anchor"]) for h in heads] == [(1, "Capitolo uno", 1, "inizio"), (2, "Fine", 1, "fine"), (3, "Stessa", 1, ""), (3, "Stessa", 2, "")]


def test_links(spark):
    links = P.page_links(pages(spark)).orderBy("pos").collect()
    assert [k["kind"] for k in links] == ["anchor", "http", "http", "blocked", "mailto"]
    assert links[1]["target"] == "https://example.com/libro/altra.html"


def test_text(spark):
    lines = [r["line"] for r in P.page_text(pages(spark)).orderBy("line_no").collect()]
    assert lines[:2] == ["[H1] Capitolo uno", "Città vai #fine"]
    assert "[H2] Fine" in lines


def test_title_anchors_and_base(spark):
    assert P.page_title(pages(spark)).first()["title"] == "Prova & pagina"
    anchors = P.page_anchors(pages(spark)).first()["anchors"]
    assert anchors["inizio"] == "[H1] Capitolo uno" and anchors["nota"].startswith("Una nota")
    html = '<link rel="canonical" href="https://www.ansa.it/sito/notizie/"><a href="/sito/static/faq.html">x</a>'
    row = pages(spark, html, "file:///x").select(P.page_base(F.col("html"), F.col("url")).alias("b"))
    assert row.first()["b"] == "https://www.ansa.it/sito/notizie/"
    assert P.page_text(pages(spark, "", None)).count() == 0


def test_resolution(spark):
    cases = [("../a", "https://h.it/a"), ("//o.it/x", "https://o.it/x"), ("?q=1", "https://h.it/p/x.html?q=1"), ("./b/../c", "https://h.it/p/c"), ("../../../d", "https://h.it/d"), ("#f", "https://h.it/p/x.html#f"), ("/r", "https://h.it/r")]
    df = spark.createDataFrame(cases, "href string, want string").withColumn("got", U.resolve(F.lit("https://h.it/p/x.html"), F.col("href")))
    assert [(r["href"], r["got"]) for r in df.collect()] == cases


def test_posts(spark):
    text = lambda t: spark.range(1).select(P.post_piece(F.lit(t))).first()[0]
    assert text("Il cielo sopra Roma stamattina era tutto rosa").startswith("Il cielo")
    assert text("Log in to X to see this post") == "" and text("Mario Rossi on X") == ""
    assert text('Mario on X: "Un testo abbastanza lungo"') == "Un testo abbastanza lungo"


def test_images(spark):
    html = '<meta property="og:image" content="https://pbs.twimg.com/media/AA.jpg"><img src="https://pbs.twimg.com/media/AA?format=png&amp;name=900x900">' + "".join(f'<img src="https://pbs.twimg.com/media/{k}?format=jpg">' for k in ("BB", "CC", "DD"))
    found = P.page_images(pages(spark, html)).orderBy("pos").collect()
    assert len(found) == 4 and "format=jpg" in found[0]["url"] and "name=large" in found[0]["url"]
    icons = spark.createDataFrame([("https://x.it/favicon.png", 0, 0), ("https://x.it/foto.jpg", 30, 30), ("https://x.it/foto2.jpg", 800, 600)], "url string, width int, height int")
    assert [r["url"] for r in P.drop_icons(icons).collect()] == ["https://x.it/foto2.jpg"]


def test_url_classes(spark):
    urls = ["https://www.raiplaysound.it/x", "https://www.netflix.com/y", "https://dazn.com", "https://www.youtube.com/watch?v=abc", "https://youtu.be/xyz?t=1", "https://x.com/a/status/1"]
    rows = P.classify_urls(spark.createDataFrame([(u,) for u in urls], "url string"), "url").collect()
    assert [r["is_media_page"] for r in rows] == [True, False, False, True, True, True]
    assert [r["is_protected"] for r in rows] == [False, True, True, False, False, False]
    assert [r["youtube_id"] for r in rows][3:5] == ["abc", "xyz"] and rows[5]["is_post"]


def test_index_and_spaces(spark):
    docs = spark.createDataFrame([(1, "English ...... 3\nItaliano .... 21\n")], "doc int, text string")
    assert [(r["title"], r["page"]) for r in D.outline_from_index(docs, "doc").orderBy("pos").collect()] == [("English (p. 3)", 3), ("Italiano (p. 21)", 21)]
    fixed = spark.range(1).select(D.restore_spaces(F.lit("Introduzione. Batteriainterna al dispositivo."), ["Batteria interna"])).first()[0]
    assert fixed == "Introduzione. Batteria interna al dispositivo."


def test_annotate(spark):
    docs = spark.createDataFrame([(1, "Uno .... 3\nTesto Uno e poi Due qui")], "doc int, text string")
    outline = spark.createDataFrame([(1, 1, 1, "Uno"), (1, 2, 2, "Due")], "doc int, pos int, level int, title string")
    text = D.annotate_headings(docs, outline, "doc").first()["text"]
    assert "[H1] Uno" in text and "[H2] Due" in text and text.startswith("Uno .... 3")


def test_internal_links(spark):
    outline = spark.createDataFrame([(1, 1, 1, "Introduzione")], "doc int, pos int, level int, title string")
    links = spark.createDataFrame([(1, 1, "Introduzione 4", "#_Toc1"), (1, 2, "web", "https://x.it")], "doc int, pos int, text string, href string")
    marks = spark.createDataFrame([(1, "_Toc9", "Altro")], "doc int, anchor string, title string")
    out = D.resolve_internal_links(links, marks, outline, "doc").orderBy("pos").collect()
    assert (out[0]["target"], out[0]["where"]) == ("Introduzione", "titolo «Introduzione»") and out[1]["target"] is None
