"""Timed transcripts: formatting, coverage, sections, chunks, mapping, pairing, quotas, clips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import kind_of
from ..functions.ranks import running
from ..functions.text import format_clock, head_of, strip_ws
from .search import split_lines

CHUNK, LEAST_CHUNK = 1600, 200
SILENT = ("nessun parlato", "no speech", "nessuna voce", "non rilevato parlato")
STAMPED = r"^\s*\[\d{1,2}:\d{2}(?::\d{2})?\]"


def format_segments(segments: DataFrame, doc: str, timestamps: bool = True) -> DataFrame:
    """doc, text of segments (doc, pos, start, text): `[MM:SS] text` lines in order."""
    line = F.concat(F.lit("["), format_clock(F.col("start")), F.lit("] "), F.trim("text")) if timestamps else F.trim("text")
    rows = segments.where(F.trim("text") != "").select(doc, F.struct("pos", line.alias("line")).alias("s"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("text"))


def last_stamp(text: Column) -> Column:
    """Seconds of the last `[MM:SS]` or `[H:MM:SS]`, -1 without one."""
    stamp = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]"), F.lit(1)), F.lit(-1))
    seconds = F.aggregate(F.split(stamp, ":"), F.lit(0).cast("long"), lambda acc, p: acc * 60 + p.cast("long"))
    return F.coalesce(seconds, F.lit(-1).cast("long"))


def transcript_coverage(reports: DataFrame, text_col: str = "text", duration_col: str = "duration") -> DataFrame:
    """Adds last_sec, incomplete, single_stamp, stuck; texts that say that nobody speaks are exempt."""
    stamps = F.regexp_extract_all(text_col, F.lit(r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]"), F.lit(1))
    silent = F.lit(False)
    for phrase in SILENT:
        silent = silent | F.lower(text_col).contains(phrase)
    last, dur = last_stamp(F.col(text_col)), F.coalesce(F.col(duration_col), F.lit(0.0))
    short = (dur > 0) & (last >= 0) & (last < dur * 0.88) & (dur - last > 45)
    still = (F.size(stamps) > 1) & F.forall(stamps, lambda s: s.rlike(r"^[0:]+$"))
    return reports.withColumns({"last_sec": last, "incomplete": short & ~silent, "single_stamp": (F.size(stamps) == 1) & ~silent, "stuck": still & ~silent})


def split_sections(reports: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """doc, pos, title, body of `=== title ===` sections; what stands before the first has pos 0 and an empty title."""
    parts = F.split(text_col, r"(?m)(?=^===[ \t]*.*?[ \t]*===[ \t]*$)")
    rows = reports.select(doc, F.posexplode(parts).alias("at", "part"))
    title = F.regexp_extract("part", r"\A===[ \t]*(.*?)[ \t]*===[ \t]*(?:\n|\z)", 1)
    body = strip_ws(F.regexp_replace("part", r"\A===[ \t]*.*?[ \t]*===[ \t]*(?:\n|\z)", ""))
    rows = rows.select(doc, "at", title.alias("title"), body.alias("body")).where("title <> '' OR body <> ''")
    order = Window.partitionBy(doc).orderBy("at")
    head = F.max(F.when(F.col("title") == "", 1).otherwise(0)).over(Window.partitionBy(doc))
    return rows.withColumn("pos", F.row_number().over(order) - head).select(doc, "pos", "title", "body")


def strip_section(text: Column, title: str) -> Column:
    """The text without its sections of one title."""
    return strip_ws(F.regexp_replace(text, rf"(?ims)^===[ \t]*\Q{title}\E[^\n]*?===[ \t]*$.*?(?=^===[ \t]*[^\n]*?===[ \t]*$|\z)", ""))


def portion_to_map(text: Column, marker: str = "trascrizione", absent: str = "(Non disponibile") -> Column:
    """Struct title, body: the first section whose title starts with the marker (null body if it is empty or not available), else the whole text."""
    title = F.regexp_extract(text, rf"(?im)^===[ \t]*({marker}.*?)[ \t]*===[ \t]*$", 1)
    body = strip_ws(F.regexp_extract(text, rf"(?ims)^===[ \t]*{marker}[^\n]*?===[ \t]*$(.*?)(?=^===[ \t]*[^\n]*?===[ \t]*$|\z)", 1))
    usable = F.when((body != "") & ~body.startswith(absent), body)
    return F.when(title != "", F.struct(title.alias("title"), usable.alias("body"))).otherwise(F.struct(F.lit("").alias("title"), F.nullif(strip_ws(text), F.lit("")).alias("body")))


def chunks_of(text: Column, max_chars: int = CHUNK) -> Column:
    """Pieces of a text: whole lines where two or more are timed, else paragraphs, one too long cut evenly. A fold over parts, no exchange."""
    limit = max(LEAST_CHUNK, max_chars)
    body = strip_ws(text)
    lines = split_lines(body)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"))

    def add_line(acc: Column, line: Column) -> Column:
        size = F.char_length(line) + 1
        full = acc["buf"].isNotNull() & (acc["size"] + size > limit)
        return (
            F.when(full, F.struct(F.concat(acc["done"], F.array(acc["buf"])).alias("done"), line.alias("buf"), size.alias("size")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat_ws("\n", acc["buf"], line).alias("buf"), (acc["size"] + size).alias("size")))
        )

    def finish(acc: Column) -> Column:
        return F.filter(F.concat(acc["done"], F.when(acc["buf"].isNotNull(), F.array(acc["buf"])).otherwise(F.array().cast("array<string>"))), lambda c: F.trim(c) != "")

    def add_part(acc: Column, part: Column) -> Column:
        held = F.when(acc["buf"].isNotNull(), F.array(acc["buf"])).otherwise(F.array().cast("array<string>"))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(part) - 1) / limit).cast("int")), lambda k: F.substring(part, k * limit + 1, F.lit(limit)))
        over = acc["buf"].isNotNull() & (F.char_length(acc["buf"]) + 2 + F.char_length(part) > limit)
        return (
            F.when(F.char_length(part) > limit, F.struct(F.concat(acc["done"], held, cuts).alias("done"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size")))
            .when(over, F.struct(F.concat(acc["done"], held).alias("done"), part.alias("buf"), F.lit(0).alias("size")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat_ws("\n\n", acc["buf"], part).alias("buf"), F.lit(0).alias("size")))
        )

    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), strip_ws), lambda p: p != "")
    timed = F.size(F.filter(lines, lambda x: x.rlike(STAMPED))) >= 2
    return F.when(body == "", F.array().cast("array<string>")).when(timed, F.aggregate(lines, start, add_line, finish)).otherwise(F.aggregate(parts, start, add_part, finish))


def chunk_text(docs: DataFrame, doc: str, text_col: str = "text", max_chars: int = CHUNK) -> DataFrame:
    """doc, pos, chunk."""
    return docs.select(doc, F.posexplode(chunks_of(F.coalesce(F.col(text_col), F.lit("")), max_chars)).alias("pos", "chunk"))


Mapper = Callable[[str], tuple[str, str, str]]


def map_chunks(chunks: DataFrame, doc: str, fn: Mapper, depth: int = 4, least: int = 400, partitions: int | None = None) -> DataFrame:
    """doc, text, error: `fn(chunk) -> (text, finish, error)` over chunks (doc, pos, chunk), joined in order.

    A result cut short (`MAX_TOKENS`) makes the chunk halve at the line break
    nearest its middle, up to `depth` times while it is longer than `least`;
    the first error of a document ends it, and what stood before it stays.
    """

    def call(text: str, left: int) -> tuple[str, str]:
        out, finish, error = fn(text)
        if error:
            return "", error
        if finish == "MAX_TOKENS" and left and len(text) > least:
            middle = len(text) // 2
            at = min((i for i, c in enumerate(text) if c == "\n" and 0 < i < len(text) - 1), key=lambda i: abs(i - middle), default=middle)
            first, error = call(text[:at], left - 1)
            if error:
                return first, error
            second, error = call(text[at:].lstrip("\n"), left - 1)
            return "\n".join(x for x in (first, second) if x), error
        return out, ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [call(c, depth) for c in pdf["chunk"]]
            yield pdf[[doc, "pos"]].assign(text=[t for t, _ in made], error=[e for _, e in made])

    dealt = chunks.repartition(partitions, doc, "pos") if partitions else chunks.repartition(doc, "pos")
    mapped = dealt.mapInPandas(run, f"{doc} {chunks.schema[doc].dataType.simpleString()}, pos int, text string, error string")
    first = F.min(F.when(F.col("error") != "", F.col("pos"))).over(Window.partitionBy(doc))
    kept = mapped.withColumn("first", first).where("first IS NULL OR pos <= first")
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    return kept.groupBy(doc).agg(text.alias("text"), F.coalesce(F.max(F.nullif("error", F.lit(""))), F.lit("")).alias("error"))


def stem_of(path: Column) -> tuple[Column, Column]:
    """Folder and lower-cased name without its last extension."""
    return F.regexp_extract(path, r"^(.*?)[^/\\]*$", 1), F.lower(F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(?<=[^.])\.[^.]*$", ""))


def pair_media_reports(media: DataFrame, reports: DataFrame, suffix: str = ".report.txt", head_chars: int | None = 12_000) -> DataFrame:
    """media_path, report_path, both ways in one: `stem` before `name.ext`, each with the suffix; null media_path for an orphan report, null report_path for a medium without one.

    A report that names a medium's whole file goes to it; one of a stem alone
    goes to each medium of that stem, and of those only to the one whose name
    its head (`head_chars` characters; None: all) mentions, if it mentions any.
    """
    folder, stem = stem_of(F.col("path"))
    m = media.select(F.col("path").alias("media_path"), folder.alias("folder"), stem.alias("stem"), F.lower(F.regexp_extract("path", r"[^/\\]*$", 0)).alias("name"), kind_of(F.col("path")).alias("kind"))
    own = F.lower(F.regexp_replace(F.regexp_extract("path", r"[^/\\]*$", 0), rf"(?i)\Q{suffix}\E$", ""))
    r = reports.select(F.col("path").alias("report_path"), folder.alias("folder"), own.alias("key"), F.lower(head_of(F.col("text"), head_chars)).alias("head"))
    pairs = r.join(m, (r["folder"] == m["folder"]) & ((r["key"] == m["stem"]) | (r["key"] == m["name"]))).drop(r["folder"])
    order = F.when(F.col("kind").isin("audio", "video"), 0).when(F.col("kind") == "image", 1).otherwise(2)
    named = F.col("head").contains(F.col("name"))
    by_report = Window.partitionBy("report_path").orderBy(F.desc(F.col("key") == F.col("name")), F.desc(named), order, "name")
    by_media = Window.partitionBy("media_path").orderBy(F.desc(F.col("key") == F.col("stem")), "report_path")
    ranked = pairs.withColumn("of_report", F.row_number().over(by_report)).withColumn("of_media", F.row_number().over(by_media))
    chosen = ranked.where("of_media = 1 OR of_report = 1").select("media_path", "report_path", "of_media", "of_report")
    forward = m.join(chosen.where("of_media = 1"), "media_path", "left").select("media_path", "report_path")
    orphans = r.join(chosen.select("report_path").distinct(), "report_path", "left_anti").select(F.lit(None).cast("string").alias("media_path"), "report_path")
    return forward.union(orphans)


def apply_quotas(files: DataFrame, folder: str, order: str, max_files: int = 5, max_sec: float = 1200) -> DataFrame:
    """Adds status: unknown, too_long, kept, or over_limit beyond the first `max_files` of a folder, in the order of an integer column."""
    usable = (F.col("duration_sec") > 0) & (F.col("duration_sec") <= max_sec)
    files = running(files.withColumn("__usable", usable), [folder, "__usable"], order, F.lit(1), "__earlier")
    state = F.when(F.coalesce("duration_sec", F.lit(0.0)) <= 0, "unknown").when(F.col("duration_sec") > max_sec, "too_long").when(F.col("__earlier") < max_files, "kept").otherwise("over_limit")
    return files.withColumn("status", state).drop("__usable", "__earlier")


def clip_segments(segments: DataFrame, start: str, end: str, duration: str, mode: str) -> DataFrame:
    """Segments (sec and the span columns) that stay after keeping or dropping a span, with new_sec and error.

    An end alone starts at 0, a start alone goes to the duration. Errors: no
    span, end not after start, start at the duration, end beyond it, all dropped;
    a segment with an error stays as it is.
    """
    lo, hi = F.coalesce(F.col(start), F.lit(0.0)), F.coalesce(F.col(end), F.col(duration))
    dur = F.coalesce(F.col(duration), F.lit(0.0))
    error = (
        F.when(F.col(start).isNull() & F.col(end).isNull(), "no span")
        .when(hi.isNull() | (hi <= 0) & F.col(end).isNull(), "end needed")
        .when(hi <= lo, "end before start")
        .when((dur > 0) & (lo >= dur - 0.05), "start beyond duration")
        .when((dur > 0) & (hi > dur + 0.35), "end beyond duration")
    )
    if mode == "drop":
        error = F.coalesce(error, F.when((dur > 0) & (lo <= 0.05) & (hi >= dur - 0.05), "all dropped"))
    out = segments.withColumn("error", error)
    inside = (F.col("sec") >= lo) & (F.col("sec") < hi)
    stays = inside if mode == "keep" else ~inside
    moved = F.col("sec") - lo if mode == "keep" else F.when(F.col("sec") >= hi, F.col("sec") - (hi - lo)).otherwise(F.col("sec"))
    return out.where(F.col("error").isNotNull() | stays).withColumn("new_sec", F.when(F.col("error").isNull(), moved).otherwise(F.col("sec")))


def remaining_length(start: Column, end: Column, duration: Column, mode: str) -> Column:
    span = F.least(F.coalesce(end, duration), duration) - F.coalesce(start, F.lit(0.0))
    return span if mode == "keep" else duration - span


def media_form(kind: Column, duration: Column, width: Column, height: Column) -> Column:
    """Form of a medium: audio, short, vertical short, normal, vertical of unknown length, unclassified."""
    dur, vertical = F.coalesce(duration, F.lit(0.0)), F.coalesce((width > 0) & (height > width), F.lit(False))
    return (
        F.when(kind == "audio", "Traccia audio")
        .when((dur > 0) & (dur <= 60), "Short (clip breve ≤ 60 s)")
        .when(vertical & (dur > 0) & (dur <= 180), "Short verticale (stile Reels/Shorts)")
        .when(dur > 0, "Video normale")
        .when(vertical, "Video verticale (durata non rilevata)")
        .otherwise("Video (forma non classificata)")
    )
