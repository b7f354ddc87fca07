"""Readers and writers on files made in a temporary folder."""

import base64
import datetime
import json
import zipfile

from pyspark.sql import functions as F

from textquarry.functions.dates import parse_feed_date
from textquarry.operators import feeds as E
from textquarry.sources import feeds as R
from textquarry.sources import files as S
from textquarry.sources import writers as W

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Notizie</title><link>https://n.it</link>
<item><title>Uno</title><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate><category>a</category><category domain="d">b</category>
<enclosure url="https://n.it/a.mp3" type="audio/mpeg" length="5"/><description>&lt;p&gt;Testo &lt;b&gt;forte&lt;/b&gt;&lt;/p&gt;</description><author>Ada Rossi (ada@n.it)</author></item>
<item><title>Due</title><guid>https://n.it/2</guid><description>piano</description></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Atomo</title><entry><title>Tre</title><id>t3</id><link href="https://a.it/3"/><link rel="enclosure" href="https://a.it/3.ogg" type="audio/ogg"/>
<updated>2024-02-01T00:00:00Z</updated><author><name>Bo</name><email>bo@a.it</email></author><category term="c" scheme="s" label="L"/><content type="html">&lt;p&gt;Corpo&lt;/p&gt;</content></entry></feed>"""
MBOX = (
    "From a@b.it Mon Jan  1 10:00:00 2024\nSubject: =?utf-8?q?Citt=C3=A0?=\nFrom: a@b.it\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: text/html; charset=utf-8\n\n<p>Ciao</p>\n"
    "\nFrom c@d.it Mon Jan  1 11:00:00 2024\nSubject: Due\nFrom: c@d.it\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nTesto\n--X\n"
    'Content-Type: application/pdf; name="a.pdf"\nContent-Disposition: attachment; filename="a.pdf"\nContent-Transfer-Encoding: base64\n\n' + base64.b64encode(b"%PDF-1.4 x").decode() + "\n--X--\n"
)


def test_decoding(spark, tmp_path):
    for name, raw in (("a.txt", "è".encode()), ("b.txt", b"\xff\xfe" + "è".encode("utf-16-le")), ("c.txt", b"\xe8\x00"), ("d.md", b"x")):
        (tmp_path / name).write_bytes(raw)
    rows = {r["name"]: r["text"] for r in S.read_text_corpus(spark, f" {tmp_path} ;").collect()}
    assert rows == {"a.txt": "è", "b.txt": "è", "c.txt": "è", "d.md": "x"}
    files = S.read_files(spark, str(tmp_path))
    assert S.filter_by_type(files, patterns="*.TXT").count() == 3 and S.filter_by_type(files, kind="document").count() == 4 and S.filter_by_type(files, ext="md").count() == 1
    assert S.filter_by_type(files, patterns="*b*").count() == 1 and S.list_by_type(files, "image").count() == 0
    assert S.size_policy(files, {"md": 0}).where("searched = 'name'").count() == 1


def test_html_charsets(spark):
    rows = [(1, b"\xef\xbb\xbfx\xc3\xa8", None), (2, "è".encode("cp1252"), None), (3, '<meta charset="iso-8859-2">č'.encode("iso-8859-2"), None), (4, "č".encode("iso-8859-2"), "iso-8859-2"), (5, "è".encode(), "nonsense")]
    df = spark.createDataFrame(rows, "id int, content binary, charset string")
    texts = {r["id"]: r["text"] for r in S.decode_html(df, "content", "charset").collect()}
    assert (texts[1], texts[2], texts[4], texts[5]) == ("xè", "è", "č", "è") and texts[3].endswith("č")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("uno.txt", "uno")
        z.writestr("sub/.hidden.txt", "no")
        z.writestr("foto.jpg", "no")
        z.writestr("sub/due.CSV", "due")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = S.read_archive_members(S.read_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["member"], r["text"]) for r in rows] == [("uno.txt", "uno"), ("sub/due.CSV", "due")]


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("b.xhtml", "<html><head><title>no</title></head><body><p>Secondo &amp; ultimo</p></body></html>")
        z.writestr("OEBPS/c.opf", '<package><manifest><item id="x" href="a.xhtml"/><item id="y" href="d.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<body><p>Due</p><p>Tre</p></body>")
        z.writestr("OEBPS/d.xhtml", "<body><h1>Uno</h1></body>")
    rows = S.epub_paragraphs(S.read_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["chapter"], r["text"]) for r in rows] == [(1, "Uno"), (2, "Due"), (2, "Tre")]


def test_office(spark, tmp_path):
    document = '<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:bookmarkStart w:id="0" w:name="_Toc1"/><w:r><w:t>Introduzione</w:t></w:r></w:p><w:p><w:hyperlink r:id="r1"><w:r><w:t>sito</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="_Toc1"><w:r><w:t>su</w:t></w:r></w:hyperlink></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", document)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="https://x.it"/></Relationships>')
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Elenco PVR" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Programma</t></si><si><t>PVR Salotto</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>21</v></c></row></sheetData></worksheet>')
    files = S.read_files(spark, str(tmp_path))
    assert [r["line"] for r in S.office_text(files).orderBy("pos").collect()][0] == "[H1] Introduzione"
    assert S.office_outline(files).first()["anchor"] == "_Toc1"
    assert [(r["text"], r["href"]) for r in S.office_links(files).orderBy("pos").collect()] == [("sito", "https://x.it"), ("su", "#_Toc1")]
    assert ("Elenco PVR", 2, "PVR Salotto\t21") in {(r["sheet"], r["row"], r["text"]) for r in S.sheet_rows(files).collect()}
    assert S.read_packaged_docs(spark, str(tmp_path)).count() == 4


def test_mailbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(MBOX)
    rows = S.read_mailbox(spark, str(tmp_path / "a.mbox")).orderBy("pos").collect()
    assert [(r["subject"], r["n_pdf"], list(r["attachments"])) for r in rows] == [("Città", 0, []), ("Due", 1, ["a.pdf"])]
    assert rows[0]["html"].strip() == "<p>Ciao</p>" and rows[1]["text"].strip() == "Testo"


def test_transcript_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"transcription": [{"timestamps": {"from": "00:00:01,200"}, "text": " La fisica dei quanti"}, {"timestamps": {"from": "00:01:03,000"}, "text": "continua qui"}, {"text": " "}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"offsets": {"from": 300}, "text": "x"}, {"start": 4.5, "text": "y"}]))
    rows = {(r["path"][-6:], r["pos"]): (r["start"], r["text"]) for r in S.read_transcript_json(spark, str(tmp_path)).collect()}
    assert rows == {("a.json", 1): (1.2, "La fisica dei quanti"), ("a.json", 2): (63.0, "continua qui"), ("b.json", 1): (3.0, "x"), ("b.json", 2): (4.5, "y")}


def test_conversations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"v": 1, "kind": "free", "title": "T", "updated": "2024-01-01T10:00:00", "turns": [{"role": "user", "text": "a"}, {"role": "system", "text": "b"}, {"role": "model", "text": "c", "model": "m"}]}))
    headers, turns = S.read_conversations(spark, str(tmp_path))
    assert headers.first()["title"] == "T" and [(r["turn"], r["role"]) for r in turns.orderBy("turn").collect()] == [(0, "user"), (2, "model")]


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RSS)
    (tmp_path / "a.xml").write_text(ATOM)
    raw = R.read_entries(spark, str(tmp_path))
    rows = {r["title"]: r for r in E.normalize_entries(raw).collect()}
    assert set(rows) == {"Uno", "Due", "Tre"}
    assert rows["Uno"]["published"] == datetime.datetime(2024, 1, 1, 9) and rows["Uno"]["link"] is None and rows["Uno"]["enclosures"][0]["href"] == "https://n.it/a.mp3"
    assert [(t["term"], t["scheme"]) for t in rows["Uno"]["tags"]] == [("a", None), ("b", "d")] and rows["Uno"]["author"] == "Ada Rossi (ada@n.it)"
    assert rows["Due"]["published"] is None and rows["Due"]["link"] == "https://n.it/2" and rows["Due"]["guid_is_link"]
    assert rows["Tre"]["link"] == "https://a.it/3" and rows["Tre"]["updated"] == datetime.datetime(2024, 2, 1) and rows["Tre"]["author"] == "Bo (bo@a.it)" and len(rows["Tre"]["enclosures"]) == 1
    entries = E.normalize_entries(raw)
    assert {r["id"]: r["text"] for r in E.entry_text(entries, "id").collect()} == {"g1": "Testo forte", "https://n.it/2": "piano", "t3": "Corpo"}
    assert [r["id"] for r in E.search_articles(entries, "id", ["forte"]).collect()] == ["g1"]
    assert {r["title"] for r in R.read_channels(spark, str(tmp_path)).collect()} == {"Notizie", "Atomo"}
    assert E.entry_media(raw).count() == 3


def test_opml(spark, tmp_path):
    (tmp_path / "f.opml").write_text('<opml><body><outline text="g"><outline text="N" xmlUrl="https://n.it/rss?a=1&amp;b=2"/></outline></body></opml>')
    assert [tuple(r) for r in R.read_opml(spark, str(tmp_path / "f.opml")).collect()] == [("https://n.it/rss?a=1&b=2", "N")]


def test_dates(spark):
    cases = [
        ("Fri, 2006/09/15 08:19:53 EDT", datetime.datetime(2006, 9, 15, 12, 19, 53)), ("2004-július-13T9:15-05:00", datetime.datetime(2004, 7, 13, 14, 15)),
        ("2004-05-25 오후 11:23:17", datetime.datetime(2004, 5, 25, 14, 23, 17)), ("Sun Jan  4 16:29:06 2004", datetime.datetime(2004, 1, 4, 16, 29, 6)),
        ("Thu, 01 Jan 04 19:48:21 GMT", datetime.datetime(2004, 1, 1, 19, 48, 21)), ("2003-12-31T10:14:55-08:00", datetime.datetime(2003, 12, 31, 18, 14, 55)),
        ("20031231", datetime.datetime(2003, 12, 31)), ("2003-335", datetime.datetime(2003, 12, 1)), ("2004년 05월 28일  01:31:15", datetime.datetime(2004, 5, 27, 16, 31, 15)),
        ("Κυρ, 11 Ιούλ 2004 12:00:00 EST", datetime.datetime(2004, 7, 11, 17)), ("Mon, 33 Foo", None), ("", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", parse_feed_date(F.col("t")).alias("d"))
    assert [r["d"] for r in df.orderBy("i").collect()] == [d for _, d in cases]


def test_geometry(spark):
    get = lambda kind, text: spark.range(1).select(E.geometry(kind, F.lit(text)).alias("g")).first()["g"]
    assert tuple(get("point", "45.2, -71.9")) == ("Point", [[-71.9, 45.2]])
    assert get("polygon", "1 2 3 4 5 6") is None and get("point", "x y") is None
    assert get("box", "1 2 3 4")["coordinates"] == [[2.0, 1.0], [4.0, 3.0]]


def test_exports(spark, tmp_path):
    hits = spark.createDataFrame([("a", "<b>")], "name string, snippet string")
    W.export_results(hits, str(tmp_path / "out"))
    W.export_results(hits, str(tmp_path / "out"), on_exists={"txt": "replace", "html": "keep", "csv": "keep"})
    assert spark.read.text(str(tmp_path / "out/html")).first()[0] == "<tr><td>a</td><td>&lt;b&gt;</td></tr>"
    files = spark.createDataFrame([("/x/out/txt/part-0",), ("/x/other.txt",)], "path string")
    kept = W.exclude_exports(files, spark.createDataFrame([("/x/out/",)], "path string"))
    assert [r["path"] for r in kept.collect()] == ["/x/other.txt"]
    html = spark.range(1).select(W.render_html(F.lit("Uno\ndue\n\nhttps://x.it & <3"))).first()[0]
    assert "<p>Uno<br>due</p>" in html and '<a href="https://x.it">https://x.it</a> &amp; &lt;3' in html


def test_entries_are_read_once_and_no_line_becomes_a_row(spark):
    """Texts of entries cross no exchange but the narrow hits of a search do; an article has one hit, lines of one page are in order."""
    body = "<p>Uno <a href='/x'>forte</a> e così via, fino a quaranta lettere e oltre</p><p>due</p><h2>Tre</h2><p> </p>"
    rows = [("f", "a", "T", None, None, "http://h.it/p", body, [body]), ("f", "b", "Forte", None, None, None, "testo", []), ("f", "c", None, None, None, None, "<p> </p>", [])]
    entries = spark.createDataFrame(rows, "feed string, id string, title string, published timestamp, updated timestamp, link string, summary string, content array<string>")
    texts = E.entry_text(entries, "id")
    assert {r["id"]: r["text"] for r in texts.collect()} == {"a": "Uno forte e così via, fino a quaranta lettere e oltre http://h.it/x\ndue\n[H2] Tre", "b": "testo"}
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan
    hits = E.search_articles(entries, "id", ["forte"])
    assert {(r["id"], r["n_raw"]) for r in hits.collect()} == {("a", 1), ("b", 0)}
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["line_no"]) for r in E.search_articles(entries, "id", ["forte"], raw_lines=True).collect()] == [("a", 0)]
