"""Containers read by range, limits that None lifts, structure of packaged documents, lines of split files."""

import os
import time
import zipfile

from pyspark.sql import functions as F

from textquarry.operators import structure as D
from textquarry.sources import containers as C
from textquarry.sources import files as S


def big_archive(path, members=2000):
    with zipfile.ZipFile(path, "w") as z:
        for k in range(members):
            z.writestr(f"m/{k:04d}.txt", f"testo {k} " * 50, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[k % 4])
        z.writestr("m/.nascosto.txt", "no")
        z.writestr("m/foto.bin", "no")


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    big_archive(tmp_path / "a.zip")
    (tmp_path / "rotto.zip").write_bytes(b"PK no archive")
    rules = C.unlimited(C.RULES)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        members = C.read_members(spark, [str(tmp_path)], rules, stretch=16 << 10)
        tasks = members.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) > 5 and sum(r["count"] for r in tasks) == 2000
    rows = {r["member"]: (r["pos"], bytes(r["raw"]).decode()) for r in members.collect()}
    assert rows == {f"m/{k:04d}.txt": (k + 1, f"testo {k} " * 50) for k in range(2000)}
    whole = {(r["member"], r["pos"], bytes(r["raw"])) for r in C.members_of(S.read_files(spark, str(tmp_path)), rules).collect()}
    assert whole == {(m, p, t.encode()) for m, (p, t) in rows.items()}


def test_a_damaged_member_is_left_out(spark, tmp_path):
    big_archive(tmp_path / "a.zip", 8)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    at = data.index(b"testo 4 ")
    data[at] = ord("T")
    (tmp_path / "a.zip").write_bytes(bytes(data))
    assert {r["member"] for r in S.read_archives(spark, str(tmp_path)).collect()} == {f"m/{k:04d}.txt" for k in range(8) if k != 4}


def test_limits(spark, tmp_path):
    big_archive(tmp_path / "a.zip", 500)
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("grande.txt", "x" * (5 << 20))
        z.writestr("piccolo.txt", "x")
    count = lambda df: {os.path.basename(r["path"]): r["count"] for r in df.groupBy("path").count().collect()}
    files = S.read_files(spark, str(tmp_path))
    assert count(S.read_archive_members(files)) == count(S.read_archives(spark, str(tmp_path))) == {"a.zip": 400, "b.zip": 1}
    assert count(S.read_archive_members(files, None, None, None)) == count(S.read_archives(spark, str(tmp_path), C.unlimited(C.RULES))) == {"a.zip": 500, "b.zip": 2}
    assert count(S.read_archive_members(files, archive_cap=10_000)) == {"b.zip": 1}


def test_chapters_and_paragraphs_beyond_the_limits(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        for k in range(90):
            z.writestr(f"c{k:02d}.xhtml", "".join(f"<p>{k} {i}</p>" for i in range(100)))
    files = S.read_files(spark, str(tmp_path))
    assert S.epub_paragraphs(files).count() == 8000
    assert S.epub_paragraphs(files, None, None).count() == 9000


def test_structure_of_books_and_office_files(spark, tmp_path):
    ncx = '<ncx><navMap><navPoint><navLabel><text>Parte &amp; uno</text></navLabel><content src="a.xhtml#x"/><navPoint><navLabel><text>Capo</text></navLabel><content src="a.xhtml#y"/></navPoint></navPoint><navPoint><navLabel><text>Due</text></navLabel><content src="b.xhtml"/></navPoint></navMap></ncx>'
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("a.xhtml", '<h2 id="h">Titolo</h2><a href="b.xhtml">avanti</a><a href="#z"></a><a href="javascript:x()">no</a><a href="https://x.it/a%20b+c"></a>')
        z.writestr("toc.ncx", ncx)
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("nav.xhtml", '<nav epub:type="toc"><ol><li><a href="c.xhtml#q">Voce</a></li></ol></nav>')
        z.writestr("c.xhtml", "<h1>Altro</h1>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:bookmarkStart w:name="_GoBack"/><w:bookmarkStart w:name="t1"/><w:t>Introduzione</w:t></w:p><w:p><w:hyperlink w:anchor="t1"><w:t>vai</w:t></w:hyperlink></w:p>')
    outline, links, bookmarks = S.packaged_structure(S.read_files(spark, str(tmp_path)))
    got = sorted((r["path"][-6:], r["pos"], r["level"], r["title"], r["anchor"]) for r in outline.collect())
    assert got == [("a.epub", 0, 1, "Parte & uno", "a.xhtml#x"), ("a.epub", 1, 2, "Capo", "a.xhtml#y"), ("a.epub", 2, 1, "Due", "b.xhtml"), ("b.epub", 0, 1, "Voce", "c.xhtml#q"), ("c.docx", 0, 1, "Introduzione", "_GoBack")]
    assert [(r["text"], r["href"]) for r in links.where("path LIKE '%a.epub'").orderBy("pos").collect()] == [("avanti", "b.xhtml"), ("https://x.it/a b+c", "https://x.it/a b+c")]
    solved = D.resolve_internal_links(links, bookmarks, outline, "path").where("path LIKE '%.docx'").first()
    assert (solved["href"], solved["target"]) == ("#t1", "Introduzione")
    assert S.packaged_structure(S.read_files(spark, str(tmp_path)), most=1)[0].count() == 3


def test_lines_of_files_that_are_split(spark, tmp_path):
    lines = [f"riga {k} è" + "\r" * (k % 2) for k in range(3000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.log").write_bytes(b"uno\n\xe8\x00\n\nfine\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = S.read_text_lines(spark, str(tmp_path))
        rows = table.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_number"], r["line"]) for r in rows if r["path"].endswith("a.txt")) == [(k + 1, x.rstrip("\r")) for k, x in enumerate(lines)]
    assert sorted((r["line_number"], r["line"]) for r in rows if r["path"].endswith("b.log")) == [(1, "uno"), (2, "è"), (3, ""), (4, "fine")]


def test_many_phrases_in_one_pass(spark):
    """20,000 phrases, of one letter to long ones, against a plain search; texts cost the same however many there are."""
    phrases = [f"parola{k} seguente{k % 7}" for k in range(20_000)] + ["a b", "è", "", "  ", "lunga " * 400]
    texts = ["nulla", "xparola77 seguente0y parola78seguente1", "A a\nb B", "lunga" * 400, "lunga" * 399, "parola19999 seguente0 perché", "", None]
    table = spark.createDataFrame([(p,) for p in phrases] * 2, "phrase string").repartition(3)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r["phrases"] for r in D.phrase_hits(docs, table, block=7000).collect()}
    bare = {p: "".join(p.split()) for p in phrases if p.split()}
    want = {k: sorted(p for p, b in bare.items() if t is not None and b in "".join(t.split())) for k, t in enumerate(texts)}
    assert got == want | {100: want[1]} and len(want[1]) == 2
    plan = D.phrase_hits(docs, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def plain_annotated(text, titles):
    import re

    used, marks = [], []
    for level, title in titles:
        found = None
        for pattern in (re.escape(title), r"\s*".join(re.escape(c) for c in title if not c.isspace())):
            for m in re.finditer(pattern, text) if found is None else ():
                line = text[text.rfind("\n", 0, m.start()) + 1 : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
                if not re.search(r"\.{2,}\s*\d{1,4}\s*$", line) and all(m.end() <= a or m.start() >= b for a, b in used):
                    found = m.span()
                    break
        if found:
            used.append(found)
            marks.append((*found, f"\n\n[H{level}] {title}\n\n"))
    out, done = "", 0
    for a, b, mark in sorted(marks):
        out += (text[done:a].lstrip(" ") if done else text[:a]).rstrip(" ") + mark
        done = b
    return (out + text[done:].lstrip(" ")).strip("\n") if marks else text


def test_headings_against_a_plain_search():
    import random

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["aba", " ", "\n", "ab", " .. 12\n", "è", "aaa", " ", "  "]) for _ in range(rng.randrange(1, 40)))
        titles = []
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(text))
            title = rng.choice([text[k : k + rng.randrange(3, 9)], "".join(text[k : k + 8].split()), "a b a", "aaa"])
            if len(title) >= 3 and title.split():
                titles.append((rng.randrange(1, 7), title))
        assert D._annotated(text, [{"level": n, "title": t} for n, t in titles]) == plain_annotated(text, titles)


def test_headings_of_a_document_of_many_lines():
    """All of 20,000 lines as titles, many of them alike: linear in text and hits."""
    lines = [f"Capitolo {k % 9000} del libro" for k in range(20_000)]
    start = time.perf_counter()
    done = D._annotated("\n".join(lines), [{"level": 1, "title": x} for x in lines])
    assert done.count("[H1] ") == 20_000 and time.perf_counter() - start < 20
