"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {"replace": "overwrite", "keep": "ignore", "fail": "error"}


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def render_html(text: Column) -> Column:
    """A text as a page: HTML as it is (wrapped if it has no html tag), else paragraphs at blank lines, breaks at line ends, addresses linked."""
    has_tags = text.rlike(r"(?i)<(html|body|p|div|br|table|span|a|h[1-6])\b[^>]*>")
    whole = text.rlike(r"(?i)<html\b")
    wrap = lambda body: F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'), body, F.lit("</body></html>"))
    parts = F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n"), lambda p: F.trim(p) != "")
    linked = lambda p: F.regexp_replace(F.replace(escaped(F.regexp_replace(p, r"^\n+|\n+$", "")), F.lit("\n"), F.lit("<br>")), r"(https?://[^\s<>\"]+)", '<a href="$1">$1</a>')
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), linked(p), F.lit("</p>"))), "\n")
    return F.when(has_tags & whole, text).when(has_tags, wrap(text)).otherwise(wrap(body))


def export_results(hits: DataFrame, path: str, formats: tuple[str, ...] = ("txt", "html", "csv"), on_exists: str | dict[str, str] = "fail") -> None:
    """The same list as text, web page rows and table, in folders below `path`; on_exists: replace, keep or fail, for all or by format."""
    rules = on_exists if isinstance(on_exists, dict) else dict.fromkeys(formats, on_exists)
    flat = hits.select([F.col(c).cast("string").alias(c) for c in hits.columns])
    for name in formats:
        mode = MODES[rules.get(name, "fail")]
        if name == "csv":
            flat.write.mode(mode).option("header", "true").csv(f"{path}/csv")
        elif name == "txt":
            flat.select(F.concat_ws("\t", *flat.columns)).write.mode(mode).text(f"{path}/txt")
        elif name == "html":
            cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>")) for c in flat.columns])
            flat.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).write.mode(mode).text(f"{path}/html")
        else:
            raise ValueError(f"unknown format {name}")


def exclude_exports(files: DataFrame, exported: DataFrame) -> DataFrame:
    """files without those below a path of an export (path), so that a search does not read its own results."""
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.call_function("substring_index", F.col("path"), F.lit("/"), n))
    folders = files.select("path", F.explode(parents).alias("parent"))
    below = folders.join(exported.select(F.regexp_replace("path", "/+$", "").alias("parent")), "parent", "left_semi").select("path")
    return files.join(below, "path", "left_anti")
