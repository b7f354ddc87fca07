"""Files as rows: decoding, filters by type and size, archives, packaged documents, mailboxes."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.kinds import KINDS, kind_of
from ..functions.markup import strip_html
from ..functions.text import extension, strip_ws
from .containers import ARCHIVE_CAP, MEMBER_CAP, MEMBERS, RULES, Rule, members_of, read_members
from .shared import batches, rows_of, written

TEXT_CAP, PDF_CAP = 40 << 20, 80 << 20
OUTLINE, LINKS = 500, 500
SPLITS = 10_000  # splits of files of which every task may hold the numbers
CHAPTERS, PARAGRAPHS, PAYLOAD = 80, 8000, 2 << 20

def roots_of(paths: str, separators: str = ";") -> list[str]:
    """Roots of a text like `a;b`, blanks around them dropped."""
    return [p for p in (x.strip() for x in re.split(f"[{re.escape(separators)}]", paths)) if p]


def read_files(spark: SparkSession, paths: str, separators: str = ";") -> DataFrame:
    """path, name, modified, length, content of all files below the roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots_of(paths, separators))
    return files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark, else UTF-8 if it is, else Latin-1; NULs removed."""
    wide = F.substring(content, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    text = F.when(wide, F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.replace(text, F.lit("\x00"), F.lit(""))


def read_text_corpus(spark: SparkSession, paths: str, separators: str = ";") -> DataFrame:
    """path, name, modified, length, text."""
    files = read_files(spark, paths, separators)
    return files.withColumn("text", decode_text(F.col("content"))).drop("content")


@F.pandas_udf(StringType())
def decode_named(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes by a charset's name; null where the name or the bytes are wrong."""

    def one(b: bytes | None, name: str | None) -> str | None:
        try:
            return b.decode(name) if b is not None and name else None
        except (LookupError, UnicodeDecodeError):
            return None

    return pd.Series([one(b, n) for b, n in zip(content, charset, strict=True)], dtype=object)


def decode_html(df: DataFrame, content_col: str, charset_col: str | None = None) -> DataFrame:
    """Adds text: UTF-16 or UTF-8 by mark, the header's charset, the page's (in its first 4000 bytes), then UTF-8, cp1252, Latin-1. Only rows with an unusual charset go through Python."""
    content = F.col(content_col)
    head = F.decode(F.substring(content, 1, 4000), "ISO-8859-1")
    own = F.lower(F.regexp_extract(head, r"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", 1))
    header = F.lower(F.trim(F.col(charset_col))) if charset_col else F.lit(None).cast("string")
    wide = F.substring(content, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    marked = F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))
    valid = F.is_valid_utf8(content.cast("string"))
    fallback = F.when(valid, content.cast("string")).otherwise(F.coalesce(decode_named(content, F.lit("cp1252")), F.decode(content, "ISO-8859-1")))
    name = F.coalesce(F.nullif(header, F.lit("")), F.nullif(own, F.lit("")), F.lit("utf-8"))
    usual = wide | marked | (name.isin("utf-8", "utf8") & valid)
    df = df.withColumn("__charset", name).withColumn("__usual", usual)
    plain = F.when(wide, F.decode(content, "UTF-16")).when(marked, F.expr(f"substring({content_col}, 4)").cast("string")).otherwise(content.cast("string"))
    quick = df.where("__usual").withColumn("text", plain)
    slow = df.where("NOT __usual").withColumn("text", F.coalesce(decode_named(content, F.col("__charset")), fallback))
    return quick.unionByName(slow).drop("__charset", "__usual")


def name_matches(name: Column, pattern: str) -> Column:
    """A file name by `*.ext`, `*mid*`, an exact name, or `*` and `*.*` for all; case aside."""
    if pattern.strip() in ("", "*", "*.*"):
        return F.lit(True)
    regex = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern.strip().lower())
    return F.lower(name).rlike(f"^{regex}$")


def filter_by_type(files: DataFrame, kind: str | None = None, ext: str | None = None, patterns: str | None = None, name_col: str = "name") -> DataFrame:
    """Files of a kind, of extensions (`pdf;epub`), or by name patterns (`*.txt;*nota*`)."""
    name, keep = F.col(name_col), F.lit(True)
    if kind:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        keep = keep & (kind_of(name) == kind)
    if ext:
        keep = keep & extension(name).isin(*[e.lstrip("*.").lower() for e in roots_of(ext, ";,")])
    if patterns:
        found = F.lit(False)
        for p in roots_of(patterns):
            found = found | name_matches(name, p)
        keep = keep & found
    return files.where(keep)


def list_by_type(files: DataFrame, kind: str) -> DataFrame:
    """Every file of a kind as a result tagged `[ELENCO]`."""
    return filter_by_type(files, kind=kind).withColumn("tag", F.lit("[ELENCO]"))


def size_policy(files: DataFrame, caps: dict[str, int] | None = None, default: int = TEXT_CAP, name_col: str = "name", size_col: str = "length") -> DataFrame:
    """Adds searched: content, or name for files above the cap of their extension."""
    caps = {"pdf": PDF_CAP, "zip": ARCHIVE_CAP, "epub": ARCHIVE_CAP, "mbox": 1 << 62} if caps is None else caps
    cap = F.lit(default)
    for ext, most in caps.items():
        cap = F.when(extension(F.col(name_col)) == ext, F.lit(most)).otherwise(cap)
    return files.withColumn("searched", F.when(F.col(size_col) > cap, "name").otherwise("content"))


def text_members(members: DataFrame) -> DataFrame:
    """path, member, pos, text of the text members of `.zip` files, of containers (path, content) or of members as `containers` reads them."""
    found = _members_of(members, "zip")
    return found.select("path", "member", "pos", decode_text(F.col("raw")).alias("text"))


def read_archive_members(files: DataFrame, most: int | None = MEMBERS, cap: int | None = MEMBER_CAP, archive_cap: int | None = ARCHIVE_CAP) -> DataFrame:
    """path, member, pos, text of the text members of `.zip` files (path, content): at most `most` of an archive, none above `cap` bytes, of archives up to `archive_cap` bytes; None for no limit."""
    return text_members(members_of(files, {"zip": replace(RULES["zip"], most=most, cap=cap, container_cap=archive_cap)}))


def read_archives(spark: SparkSession, paths: str, rules: dict[str, Rule] | None = None) -> DataFrame:
    """path, member, pos, text of the text members of all `.zip` files below the roots; large archives are read by many tasks."""
    return text_members(read_members(spark, roots_of(paths), {"zip": (rules or RULES)["zip"]}))


def read_text_lines(spark: SparkSession, paths: str, separators: str = ";") -> DataFrame:
    """path, line_number, line of text files of any size, which are split over tasks at line breaks.

    Lines end at `\\n`, a `\\r` before it goes; each is UTF-8, else Latin-1, and
    loses its NULs. (UTF-16 has no line breaks that can be seen without its
    mark: `read_text_corpus` reads it.) Lines are numbered by where each split
    starts, so texts cross no exchange.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(roots_of(paths, separators))
    meta = F.col("_metadata")
    rows = raw.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("__start"), F.monotonically_increasing_id().alias("__id"), F.col("value").cast("binary").alias("raw"))
    splits = rows.groupBy("path", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "__start", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = rows.join(F.broadcast(splits), ["path", "__start"]) if splits.limit(SPLITS + 1).count() <= SPLITS else rows.join(splits, ["path", "__start"])
    line = F.regexp_replace(decode_text(F.col("raw")), r"\r$", "")
    return numbered.select("path", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_number"), line.alias("line"))


# ------------------------------------------------------------ packaged documents


def xml_text(xml: Column) -> Column:
    """Text of a fragment of XML: tags off, entities decoded, white space collapsed."""
    return strip_html(xml, blocks=False)


def _members_of(files: DataFrame, *kinds: str) -> DataFrame:
    """Members of some kinds of containers: as they were read, or unpacked here from rows of path and content."""
    if "raw" in files.columns:
        return files.where(F.col("kind").isin(*kinds))
    return members_of(files, {k: RULES[k] for k in kinds})


def epub_chapters(files: DataFrame, chapters: int | None = CHAPTERS) -> DataFrame:
    """path, chapter, member, xml of e-books in the order of the spine, else of all (x)html members; at most `chapters` of a book, all if it is None."""
    parts = _members_of(files, "epub").withColumn("xml", decode_text(F.col("raw"))).drop("raw")
    opf = parts.where(F.lower("member").endswith(".opf")).groupBy("path").agg(F.min_by(F.struct("member", "xml"), "pos").alias("o")).select("path", "o.*")
    folder = F.regexp_extract("member", r"^(.*/)?[^/]*$", 1)
    items = opf.select("path", folder.alias("folder"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?item\b([^>]*)>"), F.lit(1))).alias("t"))
    attr = lambda c, n: F.regexp_extract(c, rf"""(?i)\b{n}\s*=\s*["']([^"']*)["']""", 1)
    items = items.select("path", attr("t", "id").alias("id"), F.concat("folder", F.coalesce(F.try_url_decode(attr("t", "href")), attr("t", "href"))).alias("member"))
    spine = opf.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"""(?is)<(?:\w+:)?itemref\b[^>]*\bidref\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("at", "id"))
    ordered = spine.join(items, ["path", "id"]).select("path", "member", "at")
    html = parts.where(F.lower("member").rlike(r"\.x?html?$")).join(ordered, ["path", "member"], "left")
    has = F.max(F.col("at").isNotNull()).over(Window.partitionBy("path"))
    html = html.withColumn("has", has).where("NOT has OR at IS NOT NULL")
    html = html.withColumn("chapter", F.row_number().over(Window.partitionBy("path").orderBy(F.coalesce("at", "pos"))))
    html = html if chapters is None else html.where(F.col("chapter") <= chapters)
    return html.select("path", "chapter", "member", "xml")


def epub_paragraphs(files: DataFrame, chapters: int | None = CHAPTERS, paragraphs: int | None = PARAGRAPHS) -> DataFrame:
    """path, chapter, pos, member, text of e-books: the paragraphs of their chapters, at most `paragraphs` of a book, all if it is None."""
    html = epub_chapters(files, chapters)
    body = F.regexp_replace("xml", r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    blocks = F.split(F.regexp_replace(body, r"(?i)<br\s*/?>|</?(?:p|div|h[1-6]|li|tr|section|blockquote)\b[^>]*>", "\x01"), "\x01")
    rows = html.select("path", "chapter", "member", F.posexplode(blocks).alias("i", "part")).withColumn("text", xml_text(F.col("part"))).where("text <> ''")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("chapter", "i")))
    rows = rows if paragraphs is None else rows.where(F.col("pos") <= paragraphs)
    return rows.select("path", "chapter", "pos", "member", "text")


def epub_outline(files: DataFrame, most: int | None = OUTLINE, chapters: int | None = CHAPTERS) -> DataFrame:
    """path, pos, level, title, anchor of e-books: the entries of the table of contents (`.ncx`, then a navigation page, whose links are all of level 1), else the headings of the chapters. The anchor is where an entry leads to, or a heading's id."""
    parts = _members_of(files, "epub").withColumn("xml", decode_text(F.col("raw"))).drop("raw")
    first = parts.where(F.lower("member").endswith(".ncx")).groupBy("path").agg(F.min_by("xml", "pos").alias("xml"))
    points = first.select("path", F.posexplode(F.split(F.regexp_extract("xml", r"(?is)<(?:\w+:)?navMap\b.*", 0), r"(?i)<(?:\w+:)?navPoint\b")).alias("i", "part"))
    closed = F.sum(F.regexp_count("part", F.lit(r"(?i)</(?:\w+:)?navPoint\s*>"))).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    label = xml_text(F.regexp_extract("part", r"(?is)<(?:\w+:)?navLabel\b[^>]*>(.*?)</(?:\w+:)?navLabel>", 1))
    source = F.regexp_extract("part", r"""(?is)<(?:\w+:)?content\b[^>]*\bsrc\s*=\s*["']([^"']*)["']""", 1)
    ncx = points.withColumn("closed", F.coalesce(closed, F.lit(0))).where("i > 0").select("path", F.lit(0).alias("rank"), F.struct(F.lit(0).alias("chapter"), "i").alias("at"), (F.col("i") - F.col("closed")).cast("int").alias("level"), label.alias("title"), source.alias("anchor"))
    html = epub_chapters(files, chapters)
    nav = parts.where(F.lower("member").rlike(r"\.x?html?$") & F.col("xml").rlike(r"""(?i)<nav\b[^>]*epub:type\s*=\s*["']toc"""))
    nav = nav.groupBy("path").agg(F.min_by("xml", "pos").alias("xml")).select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("i", "part"))
    nav = nav.select("path", F.lit(1).alias("rank"), F.struct(F.lit(0).alias("chapter"), "i").alias("at"), F.lit(1).alias("level"), xml_text(F.col("part")).alias("title"), F.regexp_extract("part", r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1).alias("anchor"))
    heads = html.select("path", "chapter", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))).alias("i", "part"))
    heads = heads.select("path", F.lit(2).alias("rank"), F.struct("chapter", "i").alias("at"), F.substring("part", 3, 1).cast("int").alias("level"), xml_text(F.col("part")).alias("title"), F.regexp_extract("part", r"""(?is)^<h\d\b[^>]*\bid\s*=\s*["']([^"']*)["']""", 1).alias("anchor"))
    every = ncx.union(nav).union(heads).where("title <> ''")
    best = every.withColumn("best", F.min("rank").over(Window.partitionBy("path"))).where("rank = best")
    rows = best.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1)
    rows = rows if most is None else rows.where(F.col("pos") < most)
    return rows.select("path", "pos", "level", "title", "anchor")


def epub_links(files: DataFrame, most: int | None = LINKS, chapters: int | None = CHAPTERS) -> DataFrame:
    """path, pos, text, href of the links of e-books in reading order: text, or else the address; no scripts, and no places within a chapter without a text."""
    found = F.regexp_extract_all("xml", F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["'][^"']*["'][^>]*>.*?</a>"""), F.lit(0))
    rows = epub_chapters(files, chapters).select("path", "chapter", F.posexplode(found).alias("i", "part"))
    href = F.trim(F.regexp_extract("part", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))
    rows = rows.select("path", "chapter", "i", xml_text(F.col("part")).alias("text"), F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href).alias("href"))
    rows = rows.where(~((F.col("text") == "") & F.col("href").startswith("#")) & ~F.lower("href").startswith("javascript:"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("chapter", "i")) - 1)
    rows = rows if most is None else rows.where(F.col("pos") < most)
    return rows.select("path", "pos", F.coalesce(F.nullif("text", F.lit("")), "href").alias("text"), "href")


def office_blocks(files: DataFrame) -> DataFrame:
    """path, pos, level (0 for text), text, raw of paragraphs of `.docx` and `.odt` files; headings by style or outline level."""
    parts = _members_of(files, "docx", "odt").where("member NOT LIKE '%.rels'")
    xml = parts.select("path", decode_text(F.col("raw")).alias("xml"))
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:w:p|text:p|text:h)\b[^>]*?(?:/>|>.*?</(?:w:p|text:p|text:h)>)"), F.lit(0))
    rows = xml.select("path", F.posexplode(found).alias("pos", "raw"))
    style = F.regexp_extract("raw", r'<w:pStyle\b[^>]*w:val="(?:[Hh]eading|Titolo)\s*(\d)"', 1)
    outline = F.regexp_extract("raw", r'<w:outlineLvl\b[^>]*w:val="(\d)"', 1).try_cast("int") + 1
    odt = F.regexp_extract("raw", r'^<text:h\b[^>]*text:outline-level="(\d+)"', 1)
    level = F.coalesce(style.try_cast("int"), outline, odt.try_cast("int"), F.lit(0))
    spaced = F.regexp_replace("raw", r"<w:tab\b[^>]*/>|<text:tab\b[^>]*/>|<w:br\b[^>]*/>|<text:s\b[^>]*/>", " ")
    return rows.select("path", "pos", level.alias("level"), xml_text(spaced).alias("text"), "raw")


def office_text(files: DataFrame) -> DataFrame:
    """path, pos, line: paragraphs, headings as `[Hn] title`."""
    rows = office_blocks(files).where("text <> ''")
    return rows.select("path", "pos", F.when(F.col("level") > 0, F.concat(F.lit("[H"), F.col("level").cast("string"), F.lit("] "), "text")).otherwise(F.col("text")).alias("line"))


def office_outline(files: DataFrame) -> DataFrame:
    """path, pos, level, title, anchor (its first bookmark)."""
    anchor = F.regexp_extract("raw", r'<(?:w:bookmarkStart\b[^>]*w:name|text:bookmark(?:-start)?\b[^>]*text:name)="([^"]*)"', 1)
    return office_blocks(files).where("level > 0 AND text <> ''").select("path", "pos", "level", F.col("text").alias("title"), anchor.alias("anchor"))


def office_links(files: DataFrame) -> DataFrame:
    """path, pos, text, href of links: external ones by their relation, internal ones as `#anchor`."""
    parts = _members_of(files, "docx", "odt").select("path", "member", decode_text(F.col("raw")).alias("xml"))
    rels = parts.where("member LIKE '%.rels'").select("path", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<Relationship\b([^>]*)>"), F.lit(1))).alias("t"))
    rels = rels.select("path", F.regexp_extract("t", r'\bId="([^"]*)"', 1).alias("rid"), F.regexp_extract("t", r'\bTarget="([^"]*)"', 1).alias("target"))
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:w:hyperlink|text:a)\b[^>]*>.*?</(?:w:hyperlink|text:a)>"), F.lit(0))
    links = parts.where("member NOT LIKE '%.rels'").select("path", F.posexplode(found).alias("pos", "raw"))
    links = links.select("path", "pos", xml_text(F.col("raw")).alias("text"), F.regexp_extract("raw", r'r:id="([^"]*)"', 1).alias("rid"), F.regexp_extract("raw", r'w:anchor="([^"]*)"', 1).alias("anchor"), F.regexp_extract("raw", r'xlink:href="([^"]*)"', 1).alias("own"))
    href = F.when(F.col("own") != "", F.col("own")).when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(F.coalesce("target", F.lit("")))
    return links.join(rels, ["path", "rid"], "left").select("path", "pos", "text", href.alias("href"))


def sheet_rows(files: DataFrame) -> DataFrame:
    """path, sheet, row, text: rows of `.xlsx` sheets, cells joined by tabs."""
    parts = _members_of(files, "xlsx").select("path", "member", decode_text(F.col("raw")).alias("xml"))
    strings = parts.where("member = 'xl/sharedStrings.xml'").select("path", F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<si\b[^>]*>(.*?)</si>"), F.lit(1)), xml_text).alias("shared"))
    names = parts.where("member = 'xl/workbook.xml'").select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r'<sheet\b[^>]*\bname="([^"]*)"'), F.lit(1))).alias("i", "sheet"))
    sheets = parts.where("member LIKE 'xl/worksheets/%'").select("path", (F.regexp_extract("member", r"(\d+)\.xml$", 1).cast("int") - 1).alias("i"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<row\b[^>]*>.*?</row>"), F.lit(0))).alias("raw"))
    rows = sheets.join(strings, "path", "left").join(names, ["path", "i"], "left")
    cells = F.regexp_extract_all("raw", F.lit(r"(?s)<c\b[^>]*?(?:/>|>.*?</c>)"), F.lit(0))
    value = lambda c: F.when(c.rlike(r'\bt="s"'), F.get("shared", F.regexp_extract(c, r"<v>(\d+)</v>", 1).try_cast("int"))).otherwise(xml_text(F.regexp_replace(c, r"(?s)^<c\b[^>]*>", "")))
    text = F.array_join(F.filter(F.transform(cells, value), lambda x: x != ""), "\t")
    return rows.select("path", "sheet", F.regexp_extract("raw", r'^<row\b[^>]*\br="(\d+)"', 1).try_cast("int").alias("row"), text.alias("text")).where("text <> ''")


def office_bookmarks(files: DataFrame) -> DataFrame:
    """path, pos, anchor, title: the bookmarks of `.docx` and `.odt` files, each with the paragraph that it stands in."""
    names = F.regexp_extract_all("raw", F.lit(r'<(?:w:bookmarkStart\b[^>]*w:name|text:bookmark(?:-start)?\b[^>]*text:name)="([^"]*)"'), F.lit(1))
    return office_blocks(files).select("path", "pos", F.explode(F.array_distinct(names)).alias("anchor"), F.col("text").alias("title")).where("anchor NOT IN ('', '_GoBack')")


def extractors(chapters: int | None = CHAPTERS, paragraphs: int | None = PARAGRAPHS) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Readers of packaged documents by extension, from members (path, kind, member, pos, raw); of a book at most `chapters` and `paragraphs`, all if they are None."""
    return {
        "epub": lambda m: epub_paragraphs(m, chapters, paragraphs).select("path", "pos", "text"),
        "docx": lambda m: office_text(m.where("kind = 'docx'")).select("path", "pos", F.col("line").alias("text")),
        "odt": lambda m: office_text(m.where("kind = 'odt'")).select("path", "pos", F.col("line").alias("text")),
        "xlsx": lambda m: sheet_rows(m).select("path", F.col("row").alias("pos"), "text"),
        "zip": lambda m: text_members(m).select("path", "pos", "text"),
    }


#: The readers in use; add to them, and to the rules of `containers`, to read more.
EXTRACTORS = extractors()


def packaged_docs(files: DataFrame, rules: dict[str, Rule] | None = None, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """path, pos, text of those of the files (path, content; or members as `containers` reads them) whose extension has a reader; `containers.unlimited` rules and `extractors(None, None)` read all of them. Each container is unpacked once; its members are written as a table that the readers share."""
    members = files if "raw" in files.columns else written(members_of(files, rules), "members")
    out = None
    for reader in (extractors or EXTRACTORS).values():
        rows = reader(members)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_packaged_docs(spark: SparkSession, paths: str, rules: dict[str, Rule] | None = None, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """path, pos, text of all documents below the roots whose extension has a reader."""
    return packaged_docs(written(read_members(spark, roots_of(paths), rules), "members"), extractors=extractors)


def packaged_structure(files: DataFrame, rules: dict[str, Rule] | None = None, most: int | None = OUTLINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outline (path, pos, level, title, anchor), links (path, pos, text, href) and bookmarks (path, pos, anchor, title) of the packaged documents among the files, in one read; at most `most` entries and links of a document, all if it is None. `resolve_internal_links` joins the three by path."""
    members = files if "raw" in files.columns else written(members_of(files, rules), "members")

    def first(rows: DataFrame) -> DataFrame:
        if most is None:
            return rows
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("__n") <= most).drop("__n")

    outline = first(office_outline(members)).unionByName(epub_outline(members, most))
    return outline, first(office_links(members)).unionByName(epub_links(members, most)), office_bookmarks(members)


# -------------------------------------------------------------------- mailboxes


def _decoded(payload: bytes, charset: str | None) -> str:
    """Text of a part by its charset; UTF-8 if it names none or an unknown one and the bytes are UTF-8, else Latin-1."""
    try:
        return payload.decode(charset, "replace") if charset else payload.decode()
    except LookupError:
        return _decoded(payload, None)
    except UnicodeDecodeError:
        return payload.decode("latin-1")


MESSAGE = pa.schema(
    {"path": pa.string(), "pos": pa.int64(), "subject": pa.string(), "sender": pa.string(), "date": pa.string(), "text": pa.string(), "html": pa.string(), "attachments": pa.list_(pa.string()), "n_pdf": pa.int32()}
)


def _message(path: str, pos: int, raw: bytes, payload_cap: int | None) -> tuple:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    texts, attached, pdfs = [], [], 0
    for part in message.walk():
        if part.is_multipart():
            continue
        try:
            payload = (part.get_payload(decode=True) or b"")[:payload_cap]
        except (LookupError, ValueError):
            payload = b""
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            attached.append(name or "")
            pdfs += payload.startswith(b"%PDF")
        elif part.get_content_maintype() == "text" and not payload.startswith(b"%PDF") and b"\0" not in payload:
            texts.append((part.get_content_subtype(), _decoded(payload, part.get_content_charset())))
    get = lambda h: str(message[h]) if message[h] is not None else ""
    return path, pos, get("subject"), get("from"), get("date"), "\n".join(t for k, t in texts if k != "html"), "\n".join(t for k, t in texts if k == "html"), attached, pdfs


def _mime(payload_cap: int | None):
    """Messages one at a time, handed on by a few megabytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((_message(*row, payload_cap) for row in rows_of(parts)), MESSAGE, MESSAGE.names.index("text"))

    return run


def read_mailbox(spark: SparkSession, path: str, payload_cap: int | None = PAYLOAD) -> DataFrame:
    """path, pos, subject, sender, date, text, html, attachments, n_pdf: a row per message of `.mbox` files of any size, which are split over tasks message by message, or `.eml` files.

    Messages are parsed as bytes, so bodies of any charset stay whole. pos grows
    along a mailbox, with gaps. Of a part the first `payload_cap` bytes are
    read, all of them if it is None.
    """
    if path.lower().rstrip("/").endswith(".eml"):
        raw = read_files(spark, path).select("path", F.lit(0).cast("long").alias("pos"), F.col("content").alias("raw"))
    else:
        # the text source hands bytes on as they are; a row starts behind "From " and holds that line's rest first
        lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))
        at = F.position(F.lit(b"\n"), F.col("raw"))
        rest = F.substring("raw", at + 1, F.length("raw"))
        raw = lines.withColumn("pos", F.monotonically_increasing_id()).where(at > 0).select("path", "pos", rest.alias("raw")).where(F.length("raw") > 0)
    return raw.mapInArrow(_mime(payload_cap), "path string, pos long, subject string, sender string, date string, text string, html string, attachments array<string>, n_pdf int")


# --------------------------------------------------------------- JSON documents


def transcript_rows(files: DataFrame, offset_unit: float = 100.0) -> DataFrame:
    """path, pos, start, text of segments of JSON files (path, content): `transcription`, `segments`, or a bare list; start is a clock, else an offset in `offset_unit`, else `start`, else 0."""
    from ..functions.text import parse_clock

    item = "struct<text string, start double, timestamps struct<`from` string>, offsets struct<`from` double>>"
    files = files.select("path", strip_ws(decode_text(F.col("content"))).alias("json"))
    body = F.from_json("json", f"struct<transcription array<{item}>, segments array<{item}>>")
    bare = F.when(F.col("json").startswith("["), F.from_json("json", f"array<{item}>"))
    rows = files.select("path", F.posexplode(F.coalesce(bare, body["transcription"], body["segments"])).alias("i", "s"))
    start = F.coalesce(parse_clock(F.col("s.timestamps.from")), F.col("s.offsets.from") / offset_unit, F.col("s.start"), F.lit(0.0))
    rows = rows.select("path", "i", start.alias("start"), strip_ws(F.col("s.text")).alias("text")).where("text <> ''")
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("i")).alias("pos"), "start", "text")


def read_transcript_json(spark: SparkSession, path: str, offset_unit: float = 100.0) -> DataFrame:
    """`transcript_rows` of the files below a path."""
    return transcript_rows(read_files(spark, path), offset_unit)


CONVERSATION = "v int, kind string, path string, title string, created string, updated string, turns array<struct<role string, text string, model string>>"


def conversation_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (conv_id, kind, title, created, updated) and turns (conv_id, turn, role, text, model) of rows of conv_id and CONVERSATION; roles user and model alone."""
    headers = raw.select("conv_id", "kind", "path", "title", F.try_to_timestamp("created").alias("created"), F.try_to_timestamp("updated").alias("updated"))
    turns = raw.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text", "t.model")
    return headers, turns.where(F.col("role").isin("user", "model"))


def read_conversations(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """`conversation_rows` of JSON files, a conversation each; without `multi_line`, of files with a conversation in each line, its title as conv_id."""
    raw = spark.read.schema(CONVERSATION).option("multiLine", str(multi_line).lower()).json(path)
    return conversation_rows(raw.select((F.col("_metadata.file_name") if multi_line else F.col("title")).alias("conv_id"), "*"))
