"""Conversations: lists, windows of turns, context, links, digests, merges, transcripts.

Tables: turns (conv_id, turn, role, text) and headers (conv_id, title, updated, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..functions.text import collapse_ws

SENT, STORED, SLICE = 80_000, 400_000, 8_000
ROOM, LEAST_ROOM = 60_000, 200


def conversation_list(turns: DataFrame, headers: DataFrame, one: str = "scambio", several: str = "scambi") -> DataFrame:
    """conv_id, title, updated, exchanges, label; conversations without an exchange are left out. `newest_first` orders them."""
    counted = turns.groupBy("conv_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("exchanges")).where("exchanges > 0")
    out = headers.join(counted, "conv_id")
    unit = F.when(F.col("exchanges") == 1, one).otherwise(several)
    label = F.concat("title", F.lit(" — "), F.date_format("updated", "dd/MM/yyyy HH:mm"), F.lit(" ("), F.col("exchanges").cast("string"), F.lit(" "), unit, F.lit(")"))
    return out.withColumn("label", label)


def newest_first(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc_nulls_last("updated"), "conv_id")


def last_turns(turns: DataFrame, n: int = 12, roles: tuple[str, ...] = ("user", "model")) -> DataFrame:
    """The last `n` turns of each conversation, and of those the ones with a role of the list and a text."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cut = turns.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
    return cut.where(F.col("role").isin(*roles) & (F.trim("text") != ""))


def conversation_title(turns: DataFrame, limit: int = 60) -> DataFrame:
    """conv_id, title: the first question, collapsed, at most `limit` characters and an ellipsis."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    flat = collapse_ws(F.col("text"))
    return first.select("conv_id", F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))).otherwise(flat).alias("title"))


def clean_title(title: Column, limit: int = 60) -> Column:
    """A name typed for a conversation: collapsed and cut."""
    return F.substring(collapse_ws(title), 1, limit)


def context_pack(docs: DataFrame, title: str, outline: str, text: str, sent: int | None = SENT, stored: int | None = STORED, modified: str | None = None) -> DataFrame:
    """Adds context: title, date of the last change (of the timestamp column `modified`), outline and text (of what is stored, as much as is sent) with a notice where it was cut; None as a cap keeps all."""
    kept = F.col(text) if stored is None else F.substring(text, 1, stored)
    parts = [F.nullif(F.col(title), F.lit(""))]
    if modified is not None:
        parts.append(F.concat(F.lit("Data di modifica del file: "), F.date_format(modified, "dd/MM/yyyy HH:mm")))
    parts.append(F.nullif(F.col(outline), F.lit("")))
    if sent is None:
        return docs.withColumn("context", F.concat_ws("\n", *parts, kept))
    notice = F.when(F.char_length(kept) > sent, F.concat(F.lit("\n(Testo tagliato a "), F.lit(str(sent)), F.lit(" caratteri.)"))).otherwise("")
    return docs.withColumn("context", F.concat_ws("\n", *parts, F.concat(F.substring(kept, 1, sent), notice)))


def attachment_budget(attachments: DataFrame, owner: str, order: str, text_col: str = "text", cap: int = ROOM) -> DataFrame:
    """Adds kept_chars and state (whole, cut, omitted): attachments share `cap` characters in the order of an integer column; one with 200 or less left is omitted."""
    size = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    attachments = running(attachments, [owner], order, size.cast("long"), "__used")
    room = F.lit(cap) - F.col("__used")
    # once one is cut nothing is left, so the sum of whole sizes tells the room of every one before that
    state = F.when(room <= LEAST_ROOM, "omitted").when(size > room, "cut").otherwise("whole")
    return attachments.withColumn("__room", room).withColumn("state", state).withColumn("kept_chars", F.when(F.col("state") == "omitted", 0).otherwise(F.least(size, F.col("__room"))).cast("long")).drop("__room", "__used")


def focus_slice(docs: DataFrame, outline: DataFrame, questions: DataFrame, doc: str, sent: int = SENT, size: int = SLICE) -> DataFrame:
    """doc, slice for documents longer than what is sent: from each place beyond it where a title that the question names (by `pagina N`, or by its words) stands, at most `size` in all."""
    page = F.regexp_extract("question", r"(?i)\bpag(?:ina|\.)?\s*(\d{1,5})\b", 1)
    asked = questions.select(doc, "question", page.alias("asked_page"))
    titled = asked.join(outline.select(doc, "title", F.col("page").cast("string").alias("page")), doc)
    by_page = titled.where("asked_page <> '' AND asked_page = page").select(doc, F.lit(0).alias("rank"), "title")
    number = asked.where("asked_page <> ''").select(doc, F.lit(1).alias("rank"), F.concat(F.lit("Pagina "), "asked_page").alias("title"))
    by_words = titled.where((F.char_length("title") >= 8) & F.lower("question").contains(F.lower("title"))).select(doc, F.lit(2).alias("rank"), "title")
    wanted = by_page.union(number).union(by_words).dropDuplicates([doc, "title"])
    long = docs.where(F.char_length("text") > sent).select(doc, "text")
    placed = wanted.join(long, doc).withColumn("at", F.call_function("locate", F.lower("title"), F.lower("text"), F.lit(sent + 1)))
    glued = F.call_function("locate", F.regexp_replace(F.lower("title"), r"\s", ""), F.lower("text"), F.lit(sent + 1))
    placed = placed.withColumn("at", F.when(F.col("at") > 0, F.col("at")).otherwise(glued)).where("at > 0")
    pieces = placed.select(doc, F.struct("rank", "at", F.substring("text", F.col("at"), F.lit(size)).alias("piece")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "\n\n")
    return pieces.groupBy(doc).agg(F.substring(joined, 1, size).alias("slice"))


def extract_links(turns: DataFrame) -> DataFrame:
    """conv_id, pos, url, label: markdown links, then `- label: http…` bullets, then bare addresses; an address keeps its first label."""
    trimmed = lambda u: F.regexp_replace(u, r"[.,;:)]+$", "")

    def found(rank: int, pattern: str, label: int, url: int) -> Column:
        urls, labels = F.regexp_extract_all("text", F.lit(pattern), F.lit(url)), F.regexp_extract_all("text", F.lit(pattern), F.lit(label))
        return F.transform(F.arrays_zip(urls.alias("url"), labels.alias("label")), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), trimmed(x["url"]).alias("url"), (F.trim(x["label"]) if label else F.lit("")).alias("label")))

    each = F.concat(found(0, r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)", 1, 2), found(1, r"(?m)^\s*[-*•]\s*([^:\n]+?):\s*(https?://\S+)", 1, 2), found(2, r"(https?://[^\s<>\"\])]+)", 0, 1))
    links = turns.select("conv_id", "turn", F.explode(each).alias("l")).select("conv_id", "turn", "l.*")
    first = F.row_number().over(Window.partitionBy("conv_id", "url").orderBy("rank", "turn", "i"))
    kept = links.withColumn("n", first).where("n = 1 AND url <> ''")
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^www\.", "")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("rank", "turn", "i"))
    return kept.select("conv_id", pos.alias("pos"), "url", F.coalesce(F.nullif("label", F.lit("")), host).alias("label"))


def content_digest(turns: DataFrame, headers: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """conv_id, digest: SHA-256 over the title, whether it was chosen (title_custom, false where headers lack it), the turns of people and model in order, and the attachments (conv_id, pos, path, title) in order. Missing texts count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kept = turns.where(F.col("role").isin("user", "model")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", text(F.col("text")).alias("text")))).alias("turns"))
    out = headers.join(kept, "conv_id", "left")
    files = F.array().cast("array<struct<path: string, title: string>>")
    if attachments is not None:
        held = attachments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", text(F.col("path")).alias("path"), text(F.col("title")).alias("title")))).alias("__files"))
        out = out.join(held, "conv_id", "left")
        files = F.coalesce(F.transform("__files", lambda a: F.struct(a["path"].alias("path"), a["title"].alias("title"))), files)
    custom = F.coalesce(F.col("title_custom"), F.lit(False)) if "title_custom" in headers.columns else F.lit(False)
    said = F.coalesce(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.array().cast("array<struct<role: string, text: string>>"))
    body = F.to_json(F.struct(files.alias("attachments"), text(F.col("title")).alias("title"), custom.alias("title_custom"), said.alias("turns")))
    return out.select("conv_id", F.sha2(body, 256).alias("digest"))


def merge_stores(ours: DataFrame, theirs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """key, digest, side of two stores (key, digest). The same key and digest is one; different digests keep both, theirs as `…__altra-copia`; with a base, a side that did not change takes the other's change."""
    a, b = ours.select("key", F.col("digest").alias("a")), theirs.select("key", F.col("digest").alias("b"))
    both = a.join(b, "key", "full").join(base.select("key", F.col("digest").alias("o")), "key", "left") if base is not None else a.join(b, "key", "full").withColumn("o", F.lit(None).cast("string"))
    taken = ours.select("key").union(theirs.select("key")).distinct().where(F.col("key").contains("__altra-copia"))
    number = taken.groupBy(F.regexp_extract("key", r"^(.*?)__altra-copia", 1).alias("key")).agg(F.count(F.lit(1)).alias("held"))
    both = both.join(number, "key", "left")
    suffix = F.when(F.col("held").isNull(), "__altra-copia").otherwise(F.concat(F.lit("__altra-copia-"), (F.col("held") + 1).cast("string")))
    rows = (
        F.when(F.col("b").isNull(), F.array(F.struct("key", F.col("a").alias("digest"), F.lit("ours").alias("side"))))
        .when(F.col("a").isNull(), F.array(F.struct("key", F.col("b").alias("digest"), F.lit("theirs").alias("side"))))
        .when(F.col("a") == F.col("b"), F.array(F.struct("key", F.col("a").alias("digest"), F.lit("both").alias("side"))))
        .when(F.col("o") == F.col("a"), F.array(F.struct("key", F.col("b").alias("digest"), F.lit("theirs").alias("side"))))
        .when(F.col("o") == F.col("b"), F.array(F.struct("key", F.col("a").alias("digest"), F.lit("ours").alias("side"))))
        .otherwise(F.array(F.struct("key", F.col("a").alias("digest"), F.lit("ours").alias("side")), F.struct(F.concat("key", suffix).alias("key"), F.col("b").alias("digest"), F.lit("theirs").alias("side"))))
    )
    return both.select(F.inline(rows)).toDF("key", "digest", "side")


def stable_key(url: Column, media_id: Column, path: Column) -> Column:
    """20 hex digits of the SHA-256 of the first of source address, media id and path, in small letters."""
    token = F.coalesce(F.nullif(F.lower(F.trim(url)), F.lit("")), F.concat(F.lit("media-id:"), F.nullif(F.lower(F.trim(media_id)), F.lit(""))), F.lower(path))
    return F.substring(F.sha2(token, 256), 1, 20)


def message_key(path: Column, index: Column) -> Column:
    """A key for one message within a file."""
    return F.substring(F.sha2(F.concat(F.lower(path), F.lit(":msg:"), F.coalesce(index, F.lit(0)).cast("string")), 256), 1, 20)


def render_transcript(turns: DataFrame, headers: DataFrame, speakers: dict[str, str] | None = None) -> DataFrame:
    """conv_id, transcript: title, date and, if turns have a column `model`, the model used last; then a block per turn with its speaker, in order."""
    names = speakers or {"user": "Tu", "model": "Gemini"}
    who = F.lit(None).cast("string")
    for role, name in names.items():
        who = F.when(F.col("role") == role, name).otherwise(who)
    model = F.when((F.col("role") == "model") & (F.col("model") != ""), F.struct("turn", "model")) if "model" in turns.columns else F.lit(None).cast("struct<turn: bigint, model: string>")
    blocks = turns.withColumn("who", who).where("who IS NOT NULL").select("conv_id", F.struct("turn", F.concat("who", F.lit(":\n"), F.trim("text")).alias("block")).alias("b"), model.alias("m"))
    joined = blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("blocks"), F.max("m").alias("m"))
    head = F.concat_ws("\n", "title", F.date_format("updated", "dd/MM/yyyy HH:mm"), F.concat(F.lit("Modello: "), F.col("m.model")))
    return headers.join(joined, "conv_id").select("conv_id", F.concat_ws("\n\n", head, "blocks").alias("transcript"))


def match_export(exports: DataFrame, conversations: DataFrame) -> DataFrame:
    """name, conv_id: an exported `title.chat.txt` leads to the current conversation with that title, else to the latest."""
    stem = F.lower(F.regexp_replace(F.regexp_extract("name", r"[^/\\]*$", 0), r"(?i)\.chat\.txt$", ""))
    found = exports.withColumn("stem", stem).join(conversations.withColumn("stem", F.lower("title")), "stem")
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("current"), F.desc_nulls_last("updated"), "conv_id"))
    return found.withColumn("n", best).where("n = 1").select("name", "conv_id")
