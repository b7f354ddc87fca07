"""Document structure: outlines, spacing, headings, internal links, reports, names."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..functions.text import collapse_ws, head_of
from ..functions.urls import let
from ..functions.windows import KeyFilter, key_length, key_of, windows
from .strings import BLOCK, strings_held

INDEX_LINE = r"(?m)([^\n.][^\n]{0,58}?[^\n. ])\s*\.{2,}[. ]*\s*(\d{1,4})\b"
HEAD = 120_000


def display_names(files: DataFrame, path_col: str) -> DataFrame:
    """Adds display_name: the base name, with the folder before it where two files share a name."""
    base = F.regexp_extract(path_col, r"[^/\\]*$", 0)
    folder = F.regexp_extract(path_col, r"([^/\\]*)[/\\][^/\\]*$", 1)
    shared = F.count(F.lit(1)).over(Window.partitionBy("__base")) > 1
    return files.withColumn("__base", base).withColumn("display_name", F.when(shared, F.concat(folder, F.lit("/"), F.col("__base"))).otherwise(F.col("__base"))).drop("__base")


def unique_names(files: DataFrame, order_col: str, style: str = "save") -> DataFrame:
    """Adds file_name from stem and ext: ` (1)`, ` (2)` after the first (save), or `-2`, `-3` (convert), in the order of an integer column."""
    files = running(files, ["stem", "ext"], order_col, F.lit(1), "__earlier")
    n = F.col("__earlier") + 1
    suffix = F.concat(F.lit(" ("), (n - 1).cast("string"), F.lit(")")) if style == "save" else F.concat(F.lit("-"), n.cast("string"))
    return files.withColumn("file_name", F.concat("stem", F.when(n == 1, "").otherwise(suffix), F.col("ext"))).drop("__earlier")


def dotted(text: Column) -> Column:
    """The text with a dash for every line that no index line can begin, lie or end in: without two dots in a row, and next to no line that has such or is blank."""
    blank = r"^\s*$"

    def kept(lines: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            # what index lines need of their neighbours: white space up to the dots behind a label, dots and white space before a number
            after, before = F.get(lines, i + 1).rlike(r"^\s*(?:\.\.|$)"), F.when(i > 0, F.get(lines, i - 1).contains("..") | F.get(lines, i - 1).rlike(blank))
            return F.when(x.contains("..") | F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False)) | x.rlike(blank), x).otherwise("-")

        return F.array_join(F.transform(lines, line), "\n")

    return let(F.split(text, "\n"), kept)


def outline_from_index(docs: DataFrame, doc: str, text_col: str = "text", pages: list[int] | None = None, most: int | None = 500, head_chars: int | None = HEAD) -> DataFrame:
    """doc, pos, title, page of dotted index lines (`label .... page`), the first per page; a page filter that leaves under 3 is given up. At most `most` of them, in the first `head_chars` characters; None for no limit."""
    found = F.regexp_extract_all(dotted(head_of(F.col(text_col), head_chars)), F.lit(INDEX_LINE), F.lit(0))
    rows = docs.select(doc, F.posexplode(found).alias("pos", "x")).select(doc, "pos", collapse_ws(F.regexp_extract("x", INDEX_LINE, 1)).alias("label"), F.regexp_extract("x", INDEX_LINE, 2).cast("int").alias("page"))
    rows = rows.where((F.char_length("label") >= 2) & ~F.col("label").rlike(r"^\d+$"))
    if pages:
        chosen = F.col("page").isin(pages)
        rows = rows.withColumn("n", F.count_if(chosen).over(Window.partitionBy(doc))).where((F.col("n") < 3) | chosen).drop("n")
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy(doc, "page").orderBy("pos"))).where("turn = 1")
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("pos")))
    numbered = numbered if most is None else numbered.where(F.col("n") <= most)
    return numbered.select(doc, F.col("n").alias("pos"), F.concat("label", F.lit(" (p. "), F.col("page").cast("string"), F.lit(")")).alias("title"), "page")


def restore_spaces(text: Column, phrases: list[str]) -> Column:
    """Known phrases of several words that stand without blanks get them back, the longest first, only where no letter adjoins."""
    for phrase in sorted({p for p in phrases if len(p.split()) > 1}, key=lambda p: (-len(p), p)):
        glued = r"\s?".join(f"\\Q{w}\\E" for w in phrase.split())
        text = F.regexp_replace(text, rf"(?<!\p{{L}}){glued}(?!\p{{L}})", " ".join(phrase.split()).replace("\\", r"\\").replace("$", r"\$"))
    return text


def phrase_hits(docs: DataFrame, phrases: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with `phrases`: those of the table's `phrase` column whose letters stand in the text without its blanks, in order; the rest cannot change it, nor can phrases of blanks alone. What a text costs does not grow with the number of phrases (see `strings_held`)."""
    forms = F.array_distinct(F.array(F.regexp_replace("phrase", " ", ""), F.regexp_replace("phrase", r"(?U)[\s\x1c-\x1f]+", "")))
    bare = phrases.where("phrase <> ''").select("phrase").distinct().select("phrase", F.explode(forms).alias("string")).where("string <> ''")
    texts = docs.select(F.md5(text_col).alias("__text"), F.regexp_replace(text_col, r"\s+", "").alias("bare"))
    hits = strings_held(texts, bare.select("string"), block).withColumnRenamed("id", "__text")
    lists = hits.join(bare, "string").groupBy("__text").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))
    return docs.withColumn("__text", F.md5(text_col)).join(lists, "__text", "left").drop("__text").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))


def glue_phrases(text: Column, phrases: Column) -> Column:
    """The text with each phrase of the list, in its order, written without blanks."""
    return F.aggregate(phrases, text, lambda t, p: F.replace(t, p, F.replace(p, F.lit(" "), F.lit(""))))


def restore_listed(text: Column, phrases: Column) -> Column:
    """`restore_spaces` by a column of phrases."""
    words = F.transform(phrases, lambda p: F.trim(F.regexp_replace(p, r"(?U)[\s\x1c-\x1f]+", " ")))
    several = F.filter(F.transform(F.arrays_zip(phrases.alias("p"), words.alias("w")), lambda x: F.struct((-F.char_length(x["p"])).alias("n"), x["p"].alias("p"), x["w"].alias("w"))), lambda x: x["w"].contains(" "))

    def put(t: Column, x: Column) -> Column:
        glued = F.concat(F.lit(r"(?<!\p{L})\Q"), F.replace(x["w"], F.lit(" "), F.lit(r"\E\s?\Q")), F.lit(r"\E(?!\p{L})"))
        return F.regexp_replace(t, glued, F.replace(F.replace(x["w"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))

    return F.aggregate(F.array_sort(several), text, put)


def _without_blanks(text: str) -> tuple[str, np.ndarray]:
    """The signs of a text that are no white space, and their places."""
    kept = np.fromiter((not c.isspace() for c in text), bool, len(text))
    return "".join(text.split()), np.flatnonzero(kept)


class Titles:
    """Where the titles of a document stand in it, with or without its blanks, found in one pass over its letters."""

    def __init__(self, text: str, titles: list[str]) -> None:
        self.text = text
        letters, self.place = _without_blanks(text)
        glued = {t: "".join(t.split()) for t in titles}
        by_key: dict[int, dict[int, set[str]]] = {}
        for g in {*glued.values()} - {""}:
            by_key.setdefault(key_of(_codes(g)), {}).setdefault(len(g), set()).add(g)
        held = KeyFilter(np.array([*by_key], np.uint64))
        self.at: dict[str, list[int]] = {}
        for _, start, hashes in windows(_codes(letters), {key_length(len(g)) for g in glued.values() if g}):
            hits = held.among(hashes)
            for k, key in zip(hits.tolist(), hashes[hits].tolist(), strict=True):
                for n, names in by_key.get(key, {}).items():
                    g = letters[start + k : start + k + n]
                    if g in names:
                        self.at.setdefault(g, []).append(start + k)
        self.glued = glued
        self.exact: dict[str, list[tuple[int, int]]] = {}
        self.loose: dict[str, list[tuple[int, int]]] = {}
        self.lines: dict[tuple[int, int], bool] = {}

    def places(self, title: str, exact: bool) -> list[tuple[int, int]]:
        """Occurrences, the first of those that overlap, the last one first; callers pop those that they have seen."""
        known = self.exact if exact else self.loose
        if title not in known:
            g = self.glued[title]
            lead = len(title) - len(title.lstrip())
            found: list[tuple[int, int]] = []
            for k in sorted(self.at.get(g, ())):
                a, b = int(self.place[k]), int(self.place[k + len(g) - 1]) + 1
                if exact:
                    a, b = a - lead, a - lead + len(title)
                    if a < 0 or self.text[a:b] != title:
                        continue
                if not found or a >= found[-1][1]:
                    found.append((a, b))
            known[title] = found[::-1]
        return known[title]

    def in_index(self, a: int, b: int) -> bool:
        """Whether the line ends with dots and a page number."""
        end = self.text.find("\n", b)
        end = len(self.text) if end < 0 else end
        line = self.text.rfind("\n", 0, a) + 1, end
        if line not in self.lines:
            self.lines[line] = re.search(r"\.{2,}\s*\d{1,4}\s*$", self.text[line[0] : end]) is not None
        return self.lines[line]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _annotated(text: str, titles: list[dict]) -> str:
    """A text with its titles in place: in their order, each at its first place that no index line and no title before it has."""
    known = Titles(text, [t["title"] for t in titles])
    starts: list[int] = []  # of taken places, in order, and their ends
    ends: list[int] = []
    marks = []
    for t in titles:
        done = False
        for exact in (True, False):
            places = known.places(t["title"], exact)
            while places and not done:
                a, b = places.pop()  # who is turned away once is for good
                k = bisect.bisect_right(starts, a)
                free = (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b)
                if free and not known.in_index(a, b):
                    starts.insert(k, a)
                    ends.insert(k, b)
                    marks.append((a, b, f"\n\n[H{t['level']}] {t['title']}\n\n"))
                    done = True
    out, end = [], len(text)
    skip = False  # the blanks behind a mark go
    for a, b, mark in sorted(marks, reverse=True):
        part = text[b:end]
        out += [part.rstrip(" ") if skip else part, mark]
        out[-2] = out[-2].lstrip(" ")
        end, skip = a, True
    out.append(text[:end].rstrip(" ") if skip else text[:end])
    return "".join(reversed(out)).strip("\n") if marks else text


def annotate_headings(docs: DataFrame, outline: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """doc, text with `[Hn] title` on a paragraph of its own at each title's first place in the body, not on index lines, not over another; titles are taken in their order, as they stand, else without blanks.

    A document's titles are looked for together, in one pass over its letters.
    Titles of fewer than 3 characters, or of blanks alone, have no place. Null
    text counts as empty.
    """
    titles = outline.where((F.char_length("title") >= 3) & ~F.col("title").rlike(r"^(?U)[\s\x1c-\x1f]*$")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title"))).alias("titles"))
    joined = docs.select(doc, F.coalesce(text_col, F.lit("")).alias("text")).join(titles, doc, "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [_annotated(text, own) if own else text for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [doc, "text"])

    return joined.mapInArrow(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, text string")


def title_keys(text: Column) -> Column:
    """Ranked keys by which a link and a title are the same: collapsed, before a tab, without a number or a dotted page at the end."""
    flat = F.lower(collapse_ws(text))
    before_tab = F.lower(collapse_ws(F.substring_index(text, "\t", 1)))
    return F.array_distinct(F.array(flat, before_tab, F.regexp_replace(flat, r"\s+\d+$", ""), F.regexp_replace(flat, r"\s*\.{2,}\s*\d+$", "")))


def resolve_internal_links(links: DataFrame, bookmarks: DataFrame, outline: DataFrame, doc: str) -> DataFrame:
    """links (doc, pos, text, href) with target and where. Web and mail links stay unresolved; an anchor leads to its bookmark (doc, anchor, title), else keys lead to the first title (doc, pos, title)."""
    local = ~F.col("href").rlike(r"(?i)^(https?|mailto):")
    marks = bookmarks.groupBy(doc, "anchor").agg(F.min("title").alias("marked"))
    out = links.withColumn("anchor", F.when(local & F.col("href").startswith("#"), F.expr("substring(href, 2)"))).join(marks, [doc, "anchor"], "left")
    keys = out.where(local & F.col("marked").isNull()).select(doc, "pos", F.posexplode(title_keys(F.col("text"))).alias("rank", "key"))
    titles = outline.select(doc, F.col("pos").alias("title_pos"), "title", F.explode(title_keys(F.col("title"))).alias("key")).where("key <> ''")
    found = keys.join(titles, [doc, "key"]).groupBy(doc, "pos").agg(F.min_by("title", F.struct("rank", "title_pos")).alias("by_title"))
    out = out.join(found, [doc, "pos"], "left").withColumn("target", F.coalesce("marked", "by_title"))
    return out.withColumn("where", F.when(F.col("target").isNotNull(), F.concat(F.lit("titolo «"), F.col("target"), F.lit("»")))).drop("marked", "by_title", "anchor")


def structure_report(docs: DataFrame, outline: DataFrame, links: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """doc, report: the outline numbered and indented by level, the links, then the text."""
    listed = outline.withColumn("line", F.concat(F.expr("repeat('  ', greatest(level, 1) - 1)"), F.col("pos").cast("string"), F.lit(". "), F.col("title")))
    heads = listed.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("heads"))
    named = links.withColumn("line", F.concat("text", F.lit(" -> "), F.coalesce("where", "href")))
    refs = named.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("refs"))
    return docs.select(doc, text_col).join(heads, doc, "left").join(refs, doc, "left").select(doc, F.concat_ws("\n\n", "heads", "refs", text_col).alias("report"))


def toc_title(links: DataFrame, toc: DataFrame) -> DataFrame:
    """links (member, fragment) with title: of the same fragment, else the member's first (toc: member, fragment, pos, title)."""
    first = toc.groupBy("member").agg(F.min_by("title", "pos").alias("first_title"))
    exact = toc.groupBy("member", "fragment").agg(F.min_by("title", "pos").alias("exact_title"))
    return links.join(exact, ["member", "fragment"], "left").join(first, "member", "left").withColumn("title", F.coalesce("exact_title", "first_title")).drop("exact_title", "first_title")
