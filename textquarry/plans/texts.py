"""Registered queries of comparing, structure, cleanup, transcripts, marks, conversations and incremental work, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..operators import cleanup as K
from ..operators import compare as C
from ..operators import conversations as V
from ..operators import incremental as I
from ..operators import marks as M
from ..operators import structure as D
from ..operators import transcripts as T
from ._tables import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- comparing


def groups(spark, d):
    """All documents, in groups of at most 12 that begin alike: the first 40 characters, and the rank within them."""
    docs = table(spark, d, "documents")
    ranked = running(docs.select("doc_id", F.substring("text", 1, 40).alias("head")), ["head"], "doc_id", F.lit(1), "n")
    ranked = ranked.select("doc_id", F.concat(F.md5("head"), F.lit("-"), F.floor(F.col("n") / 12).cast("string")).alias("grp"))
    return docs.join(ranked, "doc_id").select("grp", "doc_id", "text", "n_chars", "lang", "source")


GROUPS_SQL = r"""ranked AS (SELECT *, left(text, 40) AS head, row_number() OVER (PARTITION BY left(text, 40) ORDER BY doc_id) - 1 AS n FROM documents),
    grouped AS (SELECT md5(head) || '-' || (n // 12) AS grp, * FROM ranked)"""
CLAUSES_SQL = GROUPS_SQL + r""",
    flat AS (SELECT grp, doc_id, regexp_replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'S.p.A.', 'S' || chr(1) || 'p' || chr(1) || 'A' || chr(1)), 'S.r.l.', 'S' || chr(1) || 'r' || chr(1) || 'l' || chr(1)), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g') AS t FROM grouped),
    cut AS (SELECT grp, doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.;!?])\s+', '\1' || chr(2), 'g'), chr(2)),
            lambda p: trim(regexp_replace(trim(replace(p, chr(1), '.'), ' -'), '^\d{1,2}\s+(\d+\))', '\1'))), lambda p: p <> '') AS parts FROM flat),
    clauses AS (SELECT grp, doc_id, unnest(parts) AS clause, generate_subscripts(parts, 1) - 1 AS pos FROM cut)"""
COMMON_SQL = CLAUSES_SQL + r""",
    readable AS (SELECT grp, count(DISTINCT doc_id) AS readable FROM clauses GROUP BY grp),
    common AS (SELECT grp, clause FROM clauses JOIN readable USING (grp) WHERE readable >= 2 GROUP BY grp, clause, readable HAVING count(DISTINCT doc_id) = readable),
    differs AS (SELECT grp, doc_id, clause, min(pos) AS pos FROM clauses JOIN readable USING (grp) WHERE readable >= 2 AND (grp, clause) NOT IN (SELECT (grp, clause) FROM common) GROUP BY ALL),
    shown AS (SELECT grp, doc_id, clause, row_number() OVER (PARTITION BY grp, doc_id ORDER BY pos) AS n, greatest(count(*) OVER (PARTITION BY grp, doc_id) - 80, 0) AS hidden FROM differs)"""


@query("WITH " + CLAUSES_SQL + " SELECT grp, doc_id, pos, clause FROM clauses")
def cmp1_explode_clauses(spark, d):
    return C.explode_clauses(groups(spark, d), ["grp", "doc_id"])


@query("SELECT doc_id, 'Docusign Envelope ID: ' || regexp_replace(upper(md5(text)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS envelope FROM documents")
def cmp2_envelope_ids(spark, d):
    """Documents headed by an envelope id made of their hash."""
    digits = F.concat(F.substring(F.md5("text"), 1, 12), F.lit(" - "), F.substring(F.md5("text"), 13, 20))
    return table(spark, d, "documents").select("doc_id", F.explode(C.envelope_ids(F.concat(F.lit("Docusign Envelope ID: "), digits, F.lit(" "), "text"))).alias("envelope"))


@query("WITH " + COMMON_SQL + " SELECT grp, doc_id, n, clause, hidden FROM shown WHERE n <= 80")
def cmp3_text_differences(spark, d):
    return C.text_differences(C.explode_clauses(groups(spark, d), ["grp", "doc_id"]), "grp", "doc_id")


@query("WITH " + GROUPS_SQL + r""",
    facts AS (SELECT grp, doc_id, unnest([{'fact': 'Dimensione', 'value': n_chars::VARCHAR}, {'fact': 'Lingua', 'value': lang}, {'fact': 'Fonte', 'value': source}], recursive := true) FROM grouped)
    SELECT grp, doc_id, fact, value FROM facts QUALIFY min(value) OVER (PARTITION BY grp, fact) <> max(value) OVER (PARTITION BY grp, fact)""")
def cmp4_fact_differences(spark, d):
    return C.fact_differences(groups(spark, d), "grp", "doc_id", {"n_chars": "Dimensione", "lang": "Lingua", "source": "Fonte"})


@query("WITH " + COMMON_SQL + r""",
    per AS (SELECT g.grp, g.doc_id, s.hidden, s.doc_id IS NOT NULL AS differs, c.doc_id IS NOT NULL AS readable FROM grouped g
            LEFT JOIN (SELECT grp, doc_id, max(hidden) AS hidden FROM shown GROUP BY ALL) s USING (grp, doc_id) LEFT JOIN (SELECT DISTINCT grp, doc_id FROM clauses) c USING (grp, doc_id))
    SELECT grp, count(*) AS n_files, count(*) FILTER (WHERE NOT readable OR differs) AS differing, coalesce(sum(hidden), 0)::BIGINT AS hidden, count(*) FILTER (WHERE NOT readable OR differs) = 0 AS coincide FROM per GROUP BY grp""")
def cmp5_comparison_summary(spark, d):
    docs = groups(spark, d)
    places = C.clause_places(C.explode_clauses(docs, ["grp", "doc_id"]), "grp", "doc_id")
    return C.comparison_summary(docs, C.difference_places(places, "grp", "doc_id"), places, "grp", "doc_id")


# ---------------------------------------------------------------- structure


def indexed(spark, d):
    """Documents headed by an index of their lines, page by line number."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.char_length(x) >= 4) & ~F.substring(x, 1, 40).contains(".."))
    entries = F.transform(lines, lambda x, i: F.concat(F.regexp_replace(F.substring(x, 1, 40), r"[. ]+$", ""), F.lit(" ...... "), (i + 1).cast("string")))
    return table(spark, d, "documents").withColumn("text", F.concat(F.array_join(entries, "\n"), F.lit("\n\n"), "text"))


@query(r"""
    WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 4 AND NOT contains(left(x, 40), '..')) AS l FROM documents),
    e AS (SELECT doc_id, trim(regexp_replace(rtrim(left(unnest(l), 40), '. '), '\s+', ' ', 'g')) AS label, generate_subscripts(l, 1) AS page FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS pos FROM e WHERE length(label) >= 2)
    SELECT doc_id, pos, label || ' (p. ' || page || ')' AS title, page FROM n WHERE pos <= 500""")
def doc1_outline_from_index(spark, d):
    return D.outline_from_index(indexed(spark, d), "doc_id")


@query()
def doc2_restore_spaces(spark, d):
    """Documents with the first two words of every benchmark passage glued, and their spaces restored by those phrases."""
    phrases = table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ").alias("phrase"))
    docs = D.phrase_hits(table(spark, d, "documents").select("doc_id", "text"), phrases)
    docs = docs.withColumn("glued", D.glue_phrases(F.col("text"), F.col("phrases")))
    return docs.select("doc_id", F.md5(D.restore_listed(F.col("glued"), F.col("phrases"))).alias("text_md5"))


@query()
def doc3_annotate_headings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    outline = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.char_length(x) >= 3)).alias("pos", "line")).select("doc_id", "pos", F.lit(1).alias("level"), F.substring("line", 1, 30).alias("title"))
    return D.annotate_headings(docs, outline, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), F.regexp_count("text", F.lit(r"(?m)^\[H1\] ")).alias("headings"))


def chapters(spark, d):
    """Outline and links of conversations: turns are titles, and each links to the next by its words with a page number."""
    turns = table(spark, d, "conversations").withColumn("title", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 30))
    outline = turns.select("conv_id", F.col("turn").cast("int").alias("pos"), F.lit(1).alias("level"), "title")
    links = turns.select("conv_id", F.col("turn").cast("int").alias("pos"), F.concat("title", F.lit(" 7")).alias("text"), F.when(F.col("turn") % 4 == 3, "https://example.org/x").otherwise(F.concat(F.lit("#_t"), F.col("turn").cast("string"))).alias("href"))
    bookmarks = turns.where("turn % 2 = 0").select("conv_id", F.concat(F.lit("_t"), F.col("turn").cast("string")).alias("anchor"), F.upper("title").alias("title"))
    return outline, links, bookmarks


def resolved(spark, d):
    outline, links, bookmarks = chapters(spark, d)
    return D.resolve_internal_links(links, bookmarks, outline, "conv_id")


@query(r"""
    WITH t AS (SELECT conv_id, turn, left(regexp_replace(text, '\s+', ' ', 'g'), 30) AS title FROM conversations),
    keys AS (SELECT conv_id, turn, title, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS k FROM t),
    k2 AS (SELECT conv_id, turn, title, unnest(list_distinct([k, regexp_replace(k, '\s+\d+$', ''), regexp_replace(k, '\s*\.{2,}\s*\d+$', '')])) AS k FROM keys),
    found AS (SELECT a.conv_id, a.turn, arg_min(b.title, b.turn) AS title FROM keys a JOIN k2 b ON a.conv_id = b.conv_id AND a.k = b.k GROUP BY ALL)
    SELECT t.conv_id, t.turn::INT AS pos, CASE WHEN t.turn % 4 = 3 THEN NULL WHEN t.turn % 2 = 0 THEN replace(upper(t.title), 'ẞ', 'SS') ELSE f.title END AS target
    FROM t LEFT JOIN found f USING (conv_id, turn)""")
def doc4_resolve_internal_links(spark, d):
    return resolved(spark, d).select("conv_id", "pos", "target")


@query(r"""
    WITH t AS (SELECT conv_id, turn, left(regexp_replace(text, '\s+', ' ', 'g'), 30) AS title FROM conversations)
    SELECT conv_id, string_agg(turn || '. ' || title, chr(10) ORDER BY turn) || chr(10) || chr(10) ||
           string_agg(title || ' 7 -> ' || CASE WHEN turn % 4 = 3 THEN 'https://example.org/x' ELSE '#_t' || turn END, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'fine' AS report
    FROM t GROUP BY conv_id""")
def doc5_structure_report(spark, d):
    outline, links, _ = chapters(spark, d)
    docs = table(spark, d, "conversations").select("conv_id", F.lit("fine").alias("text")).distinct()
    return D.structure_report(docs, outline, links.withColumn("where", F.lit(None).cast("string")), "conv_id")


@query(r"""
    WITH toc AS (SELECT conv_id AS member, CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE '' END AS fragment, turn AS pos, left(text, 20) AS title FROM conversations)
    SELECT c.conv_id AS member, c.turn::VARCHAR AS fragment, coalesce(e.title, f.title) AS title FROM conversations c
    LEFT JOIN (SELECT member, fragment, arg_min(title, pos) AS title FROM toc GROUP BY ALL) e ON e.member = c.conv_id AND e.fragment = c.turn::VARCHAR
    LEFT JOIN (SELECT member, arg_min(title, pos) AS title FROM toc GROUP BY ALL) f ON f.member = c.conv_id""")
def doc6_toc_title(spark, d):
    turns = table(spark, d, "conversations")
    toc = turns.select(F.col("conv_id").alias("member"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("").alias("fragment"), F.col("turn").alias("pos"), F.substring("text", 1, 20).alias("title"))
    return D.toc_title(turns.select(F.col("conv_id").alias("member"), F.col("turn").cast("string").alias("fragment")), toc)


# ---------------------------------------------------------------- cleanup


@query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS t, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS i FROM documents)
    SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY i // 10)::INT AS line_no, string_agg(t, ' ' ORDER BY i) AS line FROM w WHERE t <> '' GROUP BY doc_id, i // 10""")
def ocr1_reading_order(spark, d):
    """Words of each document as boxes on a page, ten to a row, rows a little askew."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", r"\s+")).alias("i", "t"))
    boxes = words.select("page_id", "t", ((F.col("i") % 10) * 80.0).alias("x"), (F.floor(F.col("i") / 10) * 30.0 + F.col("i") % 3).alias("y"), F.lit(60.0).alias("w"), F.lit(18.0).alias("h"))
    return K.reading_order(boxes)


def reflowed(docs):
    """Letters of each document set one a line, a blank line for a blank, and put back into words."""
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    letters = F.transform(F.regexp_extract_all(flat, F.lit("."), F.lit(0)), lambda x: F.trim(x))
    return docs.select("doc_id", K.reflow_vertical(F.array_join(letters, "\n")).alias("text"))


@query(r"""
    WITH v AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '.') AS c FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(c, lambda x: x <> ' ')) >= 4 THEN array_to_string(string_split(array_to_string(c, ''), ' '), chr(10) || chr(10)) ELSE array_to_string(list_transform(c, lambda x: trim(x)), chr(10)) END AS text FROM v""")
def ocr2_reflow_vertical(spark, d):
    """Every letter of each document set one a line, a blank line for a blank."""
    return reflowed(table(spark, d, "documents"))


@query(r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    keyed AS (
        SELECT doc_id, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line,
               regexp_replace(translate(strip_accents(lower(regexp_replace(raw, '\s+', ' ', 'g'))), '0123456789|!l$@€', 'oizeasgtbgiiisae'), '[^\p{L}\p{N}]', '', 'g') AS k FROM lines),
    kept AS (SELECT * FROM keyed QUALIFY k = '' OR row_number() OVER (PARTITION BY doc_id, least(k, reverse(k)) ORDER BY pos) = 1)
    SELECT doc_id, md5(trim(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_md5 FROM kept GROUP BY doc_id""")
def ocr3_dedupe_lines(spark, d):
    return K.dedupe_lines(table(spark, d, "documents"), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query()
def ocr4_repair_tokens(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.replace(F.replace("text", F.lit("trash"), F.lit("tr4sh")), F.lit("worthless"), F.lit("worth less")))
    return K.repair_tokens(docs, "doc_id", ["trash", "worthless"]).select("doc_id", F.md5("text").alias("text_md5"))


@query()
def ocr5_best_candidate(spark, d):
    """Turns of a conversation as candidate readings of one item."""
    return K.best_candidate(table(spark, d, "conversations"), "conv_id", []).select("conv_id", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- transcripts


@query(r"""
    SELECT user_id, string_agg('[' || printf('%02d:%02d', s // 60, s % 60) || '] ' || event_type, chr(10) ORDER BY event_id) AS text
    FROM (SELECT *, floor(value)::BIGINT AS s FROM events) GROUP BY user_id""")
def trn1_format_segments(spark, d):
    return T.format_segments(table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), F.col("value").alias("start"), F.col("event_type").alias("text")), "user_id")


@query(r"""
    WITH t AS (SELECT user_id, max_by(floor(value)::BIGINT, event_id) AS last_sec, count(*) AS n, max(value) * 2 AS duration, bool_and(floor(value) = 0) AS zero FROM events GROUP BY user_id)
    SELECT user_id, last_sec, last_sec < duration * 0.88 AND duration - last_sec > 45 AS incomplete, n = 1 AS single_stamp, n > 1 AND zero AS stuck FROM t""")
def trn3_transcript_coverage(spark, d):
    events = table(spark, d, "events")
    texts = T.format_segments(events.select("user_id", F.col("event_id").alias("pos"), F.col("value").alias("start"), F.col("event_type").alias("text")), "user_id")
    return T.transcript_coverage(texts.join(events.groupBy("user_id").agg((F.max("value") * 2).alias("duration")), "user_id")).drop("text", "duration")


@query(r"""
    SELECT doc_id, p + 1 AS pos, CASE p WHEN 0 THEN 'Riassunto' ELSE 'Trascrizione (con timestamp)' END AS title,
           md5(regexp_replace(CASE p WHEN 0 THEN source ELSE text END, '^\s+|\s+$', '', 'g')) AS body_md5 FROM documents, range(2) r(p)""")
def trn4_split_sections(spark, d):
    report = F.concat(F.lit("=== Riassunto ===\n"), "source", F.lit("\n\n=== Trascrizione (con timestamp) ===\n"), "text")
    return T.split_sections(table(spark, d, "documents").select("doc_id", report.alias("text")), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "title", F.md5("body").alias("body_md5"))


def sectioned(spark, d):
    """Reports of a summary, a transcript (missing or not available in two of three) and a translation."""
    kind = F.col("doc_id") % 3
    middle = F.when(kind == 0, "").when(kind == 1, "\n=== Trascrizione ===\n(Non disponibile)").otherwise(F.concat(F.lit("\n=== Trascrizione (con timestamp) ===\n"), "text"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("=== Riassunto ===\n"), "source", middle, F.lit("\n=== Traduzione automatica ===\naltro\n")).alias("text"))


@query(r"""WITH r AS (SELECT doc_id, '=== Riassunto ===' || chr(10) || source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '=== Trascrizione ===' || chr(10) || '(Non disponibile)' ELSE chr(10) || '=== Trascrizione (con timestamp) ===' || chr(10) || text END AS t, text FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Trascrizione' ELSE 'Trascrizione (con timestamp)' END AS title,
           CASE doc_id % 3 WHEN 0 THEN md5(t || chr(10) || '=== Traduzione automatica ===' || chr(10) || 'altro') WHEN 2 THEN md5(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) END AS body_md5,
           md5(regexp_replace(t, '\s+$', '')) AS without_md5 FROM r""")
def trn4_portion_to_map(spark, d):
    """What of a report is to be mapped, and the report without its translation."""
    portion = T.portion_to_map(F.col("text"))
    return sectioned(spark, d).select("doc_id", portion["title"].alias("title"), F.md5(portion["body"]).alias("body_md5"), F.md5(T.strip_section(F.col("text"), "Traduzione")).alias("without_md5"))


@query(r"""
    WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
    SELECT doc_id, (i // 400)::INT AS pos, md5(substr(t, i + 1, 400)) AS chunk_md5 FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 400)) AS i FROM d WHERE t <> '')""")
def trn5_chunk_text(spark, d):
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return T.chunk_text(table(spark, d, "documents").select("doc_id", flat.alias("text")), "doc_id", max_chars=400).select("doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query()
def trn6_map_chunks(spark, d):
    """Chunks mapped by a stand-in that cuts long results short."""

    def fn(text):
        return (text.upper(), "MAX_TOKENS" if len(text) > 800 else "STOP", "")

    docs = table(spark, d, "documents").select("doc_id", "text")
    return T.map_chunks(T.chunk_text(docs, "doc_id"), "doc_id", fn).select("doc_id", F.md5("text").alias("text_md5"), "error")


def media_files(spark, d):
    """A medium for most pages, a report for two thirds, named after the whole file or its stem; reports of media that are not here are orphans."""
    media = table(spark, d, "pages").where("page_id % 5 <> 4").select(F.concat(F.lit("m/"), (F.col("page_id") % 9).cast("string"), F.lit("/clip"), F.floor(F.col("page_id") / 2).cast("string"), F.when(F.col("page_id") % 2 == 0, ".mp4").otherwise(".png")).alias("path"))
    reports = table(spark, d, "pages").where("page_id % 3 <> 1").select(F.concat(F.lit("m/"), (F.col("page_id") % 9).cast("string"), F.lit("/clip"), F.floor(F.col("page_id") / 2).cast("string"), F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, ".mp4").otherwise(".png")).otherwise(""), F.lit(".report.txt")).alias("path"), F.col("html").alias("text"))
    return media, reports


MEDIA_SQL = """named AS (SELECT *, 'm/' || (page_id % 9) || '/clip' || (page_id // 2) AS stem, CASE WHEN page_id % 2 = 0 THEN '.mp4' ELSE '.png' END AS ext FROM pages),
    pairs AS (SELECT page_id, html, CASE WHEN page_id % 5 <> 4 THEN stem || ext END AS media_path, CASE WHEN page_id % 3 <> 1 THEN stem || CASE WHEN page_id % 3 = 0 THEN ext ELSE '' END || '.report.txt' END AS report_path FROM named)"""


@query("WITH " + MEDIA_SQL + " SELECT media_path, report_path FROM pairs WHERE media_path IS NOT NULL OR report_path IS NOT NULL")
def trn7_pair_media_reports(spark, d):
    return T.pair_media_reports(*media_files(spark, d))


@query("WITH " + MEDIA_SQL + """ SELECT count(media_path) AS total, count(*) FILTER (WHERE report_path IS NOT NULL AND contains(lower(html), 'the')) AS cache_hits,
    least(count(*) FILTER (WHERE media_path IS NOT NULL AND report_path IS NULL), 30) AS transcribed, greatest(count(*) FILTER (WHERE media_path IS NOT NULL AND report_path IS NULL) - 30, 0) AS skipped_limit FROM pairs""")
def sea19_search_reports(spark, d):
    """Reports made of pages, searched for a term: totals of one search."""
    from ..operators.search import contains_all

    media, reports = media_files(spark, d)
    hits = reports.where(contains_all(F.col("text"), ["the"])).select(F.col("path").alias("report_path"))
    return I.search_summary(media, T.pair_media_reports(media, reports), hits)


@query(r"""
    WITH f AS (SELECT event_id, user_id, value * 20 AS duration_sec FROM events)
    SELECT event_id, CASE WHEN coalesce(duration_sec, 0) <= 0 THEN 'unknown' WHEN duration_sec > 1200 THEN 'too_long'
        WHEN row_number() OVER (PARTITION BY user_id, duration_sec > 0 AND duration_sec <= 1200 ORDER BY event_id) <= 5 THEN 'kept' ELSE 'over_limit' END AS status FROM f""")
def trn8_apply_quotas(spark, d):
    files = table(spark, d, "events").select("event_id", "user_id", (F.col("value") * 20).alias("duration_sec"))
    return T.apply_quotas(files, "user_id", "event_id").select("event_id", "status")


@query(r"""
    WITH s AS (SELECT event_id, value AS sec, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 10.0 END AS lo, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 30.0 + user_id % 2 * -25 END AS hi, 60.0 AS dur FROM events),
    e AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL THEN 'no span' WHEN coalesce(hi, dur) <= coalesce(lo, 0) THEN 'end before start' END AS error FROM s)
    SELECT event_id, error, round(CASE WHEN error IS NULL THEN CASE WHEN sec >= coalesce(hi, dur) THEN sec - (coalesce(hi, dur) - coalesce(lo, 0)) ELSE sec END ELSE sec END, 6) AS new_sec
    FROM e WHERE error IS NOT NULL OR NOT (sec >= coalesce(lo, 0) AND sec < coalesce(hi, dur))""")
def trn9_clip_segments(spark, d):
    e = table(spark, d, "events")
    s = e.select("event_id", F.col("value").alias("sec"), F.when(F.col("user_id") % 3 != 0, 10.0).alias("lo"), F.when(F.col("user_id") % 4 != 0, 30.0 + F.col("user_id") % 2 * -25).alias("hi"), F.lit(60.0).alias("dur"))
    return T.clip_segments(s, "lo", "hi", "dur", "drop").select("event_id", "error", F.round("new_sec", 6).alias("new_sec"))


@query(r"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Traccia audio' WHEN value > 0 AND value <= 60 THEN 'Short (clip breve ≤ 60 s)' WHEN user_id % 2 = 1 AND value > 0 AND value <= 180 THEN 'Short verticale (stile Reels/Shorts)'
        WHEN value > 0 THEN 'Video normale' WHEN user_id % 2 = 1 THEN 'Video verticale (durata non rilevata)' ELSE 'Video (forma non classificata)' END AS form FROM events""")
def trn10_media_form(spark, d):
    kind = F.when(F.col("event_type") == "error", "audio").otherwise("video")
    return table(spark, d, "events").select("event_id", T.media_form(kind, F.col("value"), F.lit(100), F.when(F.col("user_id") % 2 == 1, 200).otherwise(50)).alias("form"))


# ---------------------------------------------------------------- marks


def marks_of(spark, d):
    """A mark in every document at a third of it; every other text has since got a line before it."""
    docs = table(spark, d, "documents")
    pos = F.floor(F.char_length("text") / 3).cast("int")
    marks = docs.select(
        F.col("doc_id").alias("doc_key"), F.col("doc_id").cast("string").alias("id"), pos.alias("pos"), F.substring("text", pos + 1, F.lit(20)).alias("anchor"),
        F.substring("text", F.greatest(pos - 10, F.lit(0)) + 1, F.least(pos, F.lit(10))).alias("prefix"), F.lit("2024-01-01").cast("timestamp").alias("saved"), F.lit("").alias("excerpt"), F.lit(True).alias("is_resume"),
    )
    now = docs.select(F.col("doc_id").alias("doc_key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Nuova riga.\n"), "text")).when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    return marks, now


MARKS_SQL = r"""m AS (
        SELECT doc_id, text AS old, (length(text) // 3)::INT AS pos, CASE WHEN doc_id % 2 = 0 THEN 'Nuova riga.' || chr(10) || text WHEN doc_id % 7 = 0 THEN reverse(text) ELSE text END AS now FROM documents),
    a AS (SELECT *, substr(old, pos + 1, 20) AS anchor, substr(old, greatest(pos - 10, 0) + 1, least(pos, 10)) AS prefix FROM m)"""


@query("WITH RECURSIVE " + MARKS_SQL + r""",
    f AS (SELECT doc_id, 1 AS k, instr(now, anchor) AS p FROM a UNION ALL
          SELECT f.doc_id, k + 1, CASE WHEN instr(substr(a.now, p + 1), a.anchor) = 0 THEN 0 ELSE p + instr(substr(a.now, p + 1), a.anchor) END FROM f JOIN a USING (doc_id) WHERE k < 12 AND p > 0),
    hits AS (SELECT doc_id, list(p - 1 ORDER BY k) AS h FROM f WHERE p > 0 GROUP BY doc_id),
    r AS (SELECT a.*, h, list_filter(h, lambda x: substr(now, (greatest(x - length(prefix), 0) + 1)::BIGINT, least(x, length(prefix))::BIGINT) = prefix) AS behind FROM a LEFT JOIN hits USING (doc_id))
    SELECT doc_id AS doc_key, CASE WHEN now = '' THEN 0 WHEN anchor = '' OR substr(now, pos + 1, length(anchor)) = anchor THEN pos
               WHEN h IS NULL THEN least(pos, length(now)) WHEN prefix <> '' AND len(behind) > 0 THEN behind[1]
               ELSE list_sort(list_transform(h, lambda x: {'d': abs(x - pos), 'h': x}))[1].h END::INT AS place,
           CASE WHEN now = '' THEN 'empty' WHEN anchor = '' OR substr(now, pos + 1, length(anchor)) = anchor THEN 'exact' WHEN h IS NOT NULL THEN 'found' ELSE 'nearest' END AS outcome
    FROM r""")
def mrk1_resolve_marks(spark, d):
    return M.resolve_marks(*marks_of(spark, d)).select("doc_key", "place", "outcome")


@query(r"""
    WITH a AS (SELECT doc_id, text, length(text) // 3 AS pos FROM documents),
    l AS (SELECT doc_id, text, pos, string_split(left(text, pos), chr(10))[-1] || string_split(substr(text, pos + 1), chr(10))[1] AS line FROM a),
    e AS (SELECT doc_id, trim(regexp_replace(CASE WHEN trim(line) = '' AND pos < length(text) THEN substr(text, pos + 1, 90) ELSE line END, '\s+', ' ', 'g')) AS x FROM l)
    SELECT doc_id, CASE WHEN length(x) > 90 THEN rtrim(left(x, 89)) || '…' ELSE x END AS excerpt FROM e""")
def mrk2_excerpt_at(spark, d):
    return table(spark, d, "documents").select("doc_id", M.excerpt_at(F.col("text"), F.floor(F.char_length("text") / 3).cast("int")).alias("excerpt"))


@query()
def mrk3_add_marks(spark, d):
    """All marks after three new ones in each document, at its beginning, a third and half of it."""
    marks, now = marks_of(spark, d)
    new = now.select("doc_key", F.explode(F.array(F.lit(0), F.floor(F.char_length("text") / 3).cast("int"), F.floor(F.char_length("text") / 2).cast("int"))).alias("pos"), F.lit("2024-02-01").cast("timestamp").alias("saved"))
    found = M.add_marks(marks, new.withColumn("saved", F.timestamp_add("SECOND", F.col("pos"), "saved")), now)
    return found.select("doc_key", "id", "pos", "place", "is_resume", "status", F.md5("anchor").alias("anchor_md5"))


def stores(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_key"), (F.col("event_id") % 40).cast("string").alias("id"), F.floor("value").cast("int").alias("pos"), "event_type", "event_id", "ts")
    own = lambda r: e.where(F.col("event_id") % 3 != r).groupBy("doc_key", "id").agg(F.min_by("pos", "event_id").alias("pos"), F.min_by("event_type", "event_id").alias("anchor"), F.max("ts").alias("saved")).withColumn("is_resume", F.col("id") == "7")
    return own(0), own(1)


STORES_SQL = r"""e AS (SELECT user_id AS doc_key, (event_id % 40)::VARCHAR AS id, floor(value)::INT AS pos, event_type, event_id, ts FROM events),
    ours AS (SELECT doc_key, id, arg_min(pos, event_id) AS pos, arg_min(event_type, event_id) AS anchor, max(ts) AS saved, id = '7' AS is_resume FROM e WHERE event_id % 3 <> 0 GROUP BY ALL),
    theirs AS (SELECT doc_key, id, arg_min(pos, event_id) AS pos, arg_min(event_type, event_id) AS anchor, max(ts) AS saved, id = '7' AS is_resume FROM e WHERE event_id % 3 <> 1 GROUP BY ALL)"""


@query("WITH " + STORES_SQL + r""",
    ours2 AS (SELECT doc_key, id, pos, anchor, is_resume FROM ours UNION ALL SELECT doc_key, id || '-altra-' || (pos % 3 + 1), pos + 1000, anchor, false FROM ours WHERE id::INT % 3 = 0),
    theirs2 AS (SELECT doc_key, id, pos, anchor, is_resume FROM theirs UNION ALL SELECT doc_key, id || '-altra-1', pos + 2000, anchor, false FROM theirs WHERE id::INT % 5 = 0
                UNION ALL SELECT doc_key, id || '-nuovo', pos, anchor, false FROM theirs WHERE id::INT % 7 = 0),
    ids AS (SELECT doc_key, id FROM ours2 UNION SELECT doc_key, id FROM theirs2),
    new AS (SELECT t.* FROM theirs2 t WHERE NOT EXISTS (SELECT 1 FROM ours2 o WHERE o.doc_key = t.doc_key AND o.pos = t.pos AND o.anchor = t.anchor AND (o.id = t.id OR regexp_full_match(o.id, t.id || '-altra-[0-9]+')))),
    clash AS (SELECT n.* FROM new n SEMI JOIN ours2 o USING (doc_key, id)),
    free AS (SELECT doc_key, id, min(k) AS k FROM (SELECT doc_key, c.id, k FROM clash c, range(1, 9) r(k) ANTI JOIN ids i ON i.doc_key = c.doc_key AND i.id = c.id || '-altra-' || k) GROUP BY ALL),
    resume AS (SELECT doc_key, bool_or(is_resume) AS has FROM ours2 GROUP BY 1),
    every AS (
        SELECT doc_key, id, pos, anchor, is_resume, 0 AS side FROM ours2 UNION ALL
        SELECT n.doc_key, CASE WHEN f.k IS NOT NULL THEN n.id || '-altra-' || f.k ELSE n.id END, n.pos, n.anchor, n.is_resume AND NOT coalesce(r.has, false), 1
        FROM new n LEFT JOIN free f ON f.doc_key = n.doc_key AND f.id = n.id LEFT JOIN resume r ON r.doc_key = n.doc_key)
    SELECT doc_key, id, pos, anchor, is_resume FROM every QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY side, pos, id) <= 100""")
def mrk4_merge_marks(spark, d):
    """Two stores, both with copies of earlier merges, and new marks at places that the other store knows."""
    ours, theirs = (x.select("doc_key", "id", "pos", "anchor", "is_resume") for x in stores(spark, d))
    number = F.col("id").cast("int")

    def more(df, keep, name, by):
        return df.where(keep).select("doc_key", F.concat("id", name).alias("id"), (F.col("pos") + by).alias("pos"), "anchor", F.lit(False).alias("is_resume"))

    ours = ours.union(more(ours, number % 3 == 0, F.concat(F.lit("-altra-"), (F.col("pos") % 3 + 1).cast("string")), 1000))
    theirs = theirs.union(more(theirs, number % 5 == 0, F.lit("-altra-1"), 2000)).union(more(theirs, number % 7 == 0, F.lit("-nuovo"), 0))
    return M.merge_marks(ours, theirs)


@query("WITH " + STORES_SQL + r""",
    lost AS (SELECT doc_key, pos AS lost FROM ours WHERE is_resume), kept AS (SELECT o.*, l.lost FROM ours o LEFT JOIN lost l USING (doc_key) WHERE NOT o.is_resume)
    SELECT doc_key, id, lost IS NOT NULL AND row_number() OVER (PARTITION BY doc_key ORDER BY abs(pos - lost), pos, id) = 1 AS is_resume FROM kept""")
def mrk5_delete_marks(spark, d):
    ours, _ = stores(spark, d)
    return M.delete_marks(ours, ours.where("is_resume").select("doc_key", "id")).select("doc_key", "id", "is_resume")


@query("WITH " + STORES_SQL + " SELECT o.doc_key, o.id FROM ours o SEMI JOIN (SELECT doc_key, max(saved) AS saved FROM ours GROUP BY 1 ORDER BY saved DESC, doc_key LIMIT 20) USING (doc_key)")
def mrk6_trim_docs(spark, d):
    return M.trim_docs(stores(spark, d)[0], 20).select("doc_key", "id")


@query("WITH " + STORES_SQL + r""" SELECT doc_key, id, row_number() OVER (PARTITION BY doc_key ORDER BY pos, id) AS place_no, count(*) OVER (PARTITION BY doc_key) AS total,
    row_number() OVER (PARTITION BY doc_key ORDER BY pos, id) || ' di ' || count(*) OVER (PARTITION BY doc_key) || ': ' || anchor || CASE WHEN is_resume THEN ' (ripresa)' ELSE '' END AS label FROM ours""")
def mrk7_describe_marks(spark, d):
    return M.describe_marks(stores(spark, d)[0].withColumn("excerpt", F.col("anchor"))).select("doc_key", "id", "place_no", "total", "label")


@query("WITH " + STORES_SQL + r""" SELECT doc_key AS media, id, row_number() OVER (PARTITION BY doc_key ORDER BY pos::DOUBLE, id) AS place_no,
    row_number() OVER (PARTITION BY doc_key ORDER BY is_resume DESC, saved DESC, id DESC) = 1 AS last FROM ours""")
def mrk8_media_marks(spark, d):
    marks = stores(spark, d)[0].select(F.col("doc_key").alias("media"), "id", F.col("pos").cast("double").alias("sec"), F.col("anchor").alias("name"), F.col("saved").alias("ts"), "is_resume")
    return M.media_marks(marks).select("media", "id", "place_no", "last")


@query("WITH " + STORES_SQL + " SELECT doc_key AS media, id, CASE id::INT % 4 WHEN 0 THEN 'Nome ' || id ELSE anchor END AS name FROM ours")
def mrk8_rename_media_mark(spark, d):
    """Every fourth mark gets a name, the next one a blank one, which changes nothing."""
    marks = stores(spark, d)[0].select(F.col("doc_key").alias("media"), "id", F.col("anchor").alias("name"))
    kind = F.col("id").cast("int") % 4
    names = marks.where(kind < 2).select("media", "id", F.when(kind == 0, F.concat(F.lit(" Nome "), "id")).otherwise("  ").alias("new_name"))
    return M.rename_media_mark(marks, names)


@query("WITH " + STORES_SQL + r""",
    gone AS (SELECT * FROM ours WHERE is_resume OR id::INT % 5 = 0), lost AS (SELECT doc_key FROM gone WHERE is_resume),
    kept AS (SELECT o.*, l.doc_key IS NOT NULL AS lost FROM ours o ANTI JOIN gone g USING (doc_key, id) LEFT JOIN lost l ON l.doc_key = o.doc_key)
    SELECT doc_key AS media, id, CASE WHEN lost THEN row_number() OVER (PARTITION BY doc_key ORDER BY pos DESC, id DESC) = 1 ELSE is_resume END AS is_resume FROM kept""")
def mrk8_delete_media_marks(spark, d):
    marks = stores(spark, d)[0].select(F.col("doc_key").alias("media"), "id", F.col("pos").cast("double").alias("sec"), "is_resume")
    return M.delete_media_marks(marks, marks.where(F.col("is_resume") | (F.col("id").cast("int") % 5 == 0)).select("media", "id")).drop("sec")


# ---------------------------------------------------------------- conversations


def chats(spark, d):
    """Turns with the model's role as the operators name it, and headers with a title and a time that follow from the conversation."""
    turns = table(spark, d, "conversations").where("role <> 'system'").withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")))
    headers = turns.groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 20), "turn").alias("title")).withColumn("updated", F.timestamp_add("MINUTE", (F.col("conv_id") * 7919 % 100000).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    return turns, headers


CHATS_SQL = r"""turns AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM conversations WHERE role <> 'system'),
    headers AS (SELECT conv_id, arg_min(left(text, 20), turn) AS title, TIMESTAMP '2024-01-01' + to_minutes((conv_id * 7919 % 100000)::INT) AS updated FROM turns GROUP BY conv_id)"""


@query("WITH " + CHATS_SQL + r""", n AS (SELECT conv_id, count(*) // 2 AS exchanges FROM turns GROUP BY conv_id HAVING count(*) // 2 > 0)
    SELECT conv_id, title, updated, exchanges, title || ' — ' || strftime(updated, '%d/%m/%Y %H:%M') || ' (' || exchanges || CASE WHEN exchanges = 1 THEN ' scambio)' ELSE ' scambi)' END AS label FROM headers JOIN n USING (conv_id)""")
def cnv1_conversation_list(spark, d):
    return V.conversation_list(*chats(spark, d))


@query("WITH " + CHATS_SQL + " SELECT conv_id, turn, role FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) WHERE trim(text) <> ''")
def cnv2_last_turns(spark, d):
    return V.last_turns(chats(spark, d)[0], 4).select("conv_id", "turn", "role")


@query("WITH " + CHATS_SQL + r""", q AS (SELECT conv_id, arg_min(trim(regexp_replace(text, '\s+', ' ', 'g')), turn) AS t FROM turns WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, CASE WHEN length(t) > 60 THEN rtrim(left(t, 60)) || '…' ELSE t END AS title FROM q""")
def cnv3_conversation_title(spark, d):
    return V.conversation_title(chats(spark, d)[0])


@query(r"""SELECT doc_id, md5(source || chr(10) || 'Data di modifica del file: ' || strftime(TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919 % 100000)::INT), '%d/%m/%Y %H:%M') || chr(10) || lang || chr(10) || left(left(text, 4000), 2000) || CASE WHEN length(left(text, 4000)) > 2000 THEN chr(10) || '(Testo tagliato a 2000 caratteri.)' ELSE '' END) AS context_md5,
    md5(source || chr(10) || lang || chr(10) || text) AS whole_md5 FROM documents""")
def cnv4_context_pack(spark, d):
    """Contexts with a date and caps, and whole ones."""
    dated = table(spark, d, "documents").withColumn("modified", F.timestamp_add("MINUTE", (F.col("doc_id") * 7919 % 100000).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    cut = V.context_pack(dated, "source", "lang", "text", 2000, 4000, "modified").withColumnRenamed("context", "cut")
    return V.context_pack(cut, "source", "lang", "text", None, None).select("doc_id", F.md5("cut").alias("context_md5"), F.md5("context").alias("whole_md5"))


@query(r"""
    WITH r AS (SELECT doc_id, length(text) AS n, 60000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents)
    SELECT doc_id, CASE WHEN room <= 200 THEN 'omitted' WHEN n > room THEN 'cut' ELSE 'whole' END AS state, CASE WHEN room <= 200 THEN 0 ELSE least(n, room) END::BIGINT AS kept_chars FROM r""")
def cnv5_attachment_budget(spark, d):
    return V.attachment_budget(table(spark, d, "documents"), "source", "doc_id").select("doc_id", "state", "kept_chars")


@query("""WITH d AS (SELECT doc_id, text, instr(substr(lower(text), 2001), lower(substr(text, 2500, 12))) AS place FROM documents WHERE length(text) > 2600)
    SELECT doc_id, md5(substr(text, (2000 + place)::BIGINT, 800)) AS slice_md5 FROM d""")
def cnv6_focus_slice(spark, d):
    """A slice of every document longer than 2000 characters, by a question that names a word beyond them and a page."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    outline = docs.where(F.char_length("text") > 2600).select("doc_id", F.substring("text", 2500, 12).alias("title"), F.lit(3).alias("page"))
    questions = docs.select("doc_id", F.lit("Che cosa dice pagina 3?").alias("question"))
    return V.focus_slice(docs, outline, questions, "doc_id", 2000, 800).select("doc_id", F.md5("slice").alias("slice_md5"))


@query("WITH " + CHATS_SQL + """, l AS (SELECT DISTINCT conv_id, 0 AS rank, 0 AS turn, 'https://example.org/' || conv_id || '/0' AS url, 'qui' AS label FROM turns
        UNION ALL SELECT conv_id, 1, turn, 'https://example.org/' || conv_id || '/' || turn, 'fonte' FROM turns WHERE turn <> 0
        UNION ALL SELECT conv_id, 2, turn, 'https://www.esa.int/' || turn, 'esa.int' FROM turns)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn) AS pos, url, label FROM l""")
def cnv7_extract_links(spark, d):
    """Links of turns to which addresses made of their place were added."""
    turns = chats(spark, d)[0].withColumn("text", F.concat("text", F.lit("\n- fonte: https://example.org/"), "conv_id", F.lit("/"), "turn", F.lit(".\nVedi [qui](https://example.org/"), "conv_id", F.lit("/0) e https://www.esa.int/"), "turn", F.lit(".")))
    return V.extract_links(turns)


@query("WITH " + CHATS_SQL + r""",
    t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns FROM turns WHERE role IN ('user', 'model') GROUP BY conv_id),
    a AS (SELECT conv_id, list({'path': 'c:/' || turn || '.pdf', 'title': left(text, 9)} ORDER BY turn) AS files FROM turns WHERE turn % 3 = 1 GROUP BY conv_id)
    SELECT h.conv_id, sha256(to_json({'attachments': coalesce(files, []), 'title': h.title, 'title_custom': h.conv_id % 4 = 0, 'turns': coalesce(turns, [])})::VARCHAR) AS digest
    FROM headers h LEFT JOIN t USING (conv_id) LEFT JOIN a USING (conv_id)""")
def cnv8_content_digest(spark, d):
    """Digests of conversations of which every fourth has a chosen title, and every third turn brings a file."""
    turns, headers = chats(spark, d)
    files = turns.where("turn % 3 = 1").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("c:/"), F.col("turn").cast("string"), F.lit(".pdf")).alias("path"), F.substring("text", 1, 9).alias("title"))
    return V.content_digest(turns, headers.withColumn("title_custom", F.col("conv_id") % 4 == 0), files)


def digests(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("k"), (F.col("c_custkey") % 700).cast("string")).alias("key"), F.col("c_custkey").alias("n"))
    own = lambda r: c.where(F.col("n") % 5 != r).groupBy("key").agg(F.md5(F.min("n").cast("string")).alias("digest"))
    return own(0), own(1), own(2)


@query(r"""
    WITH c AS (SELECT 'k' || (c_custkey % 700) AS key, c_custkey AS n FROM customer),
    a AS (SELECT key, md5(min(n)::VARCHAR) AS a FROM c WHERE n % 5 <> 0 GROUP BY key), b AS (SELECT key, md5(min(n)::VARCHAR) AS b FROM c WHERE n % 5 <> 1 GROUP BY key),
    o AS (SELECT key, md5(min(n)::VARCHAR) AS o FROM c WHERE n % 5 <> 2 GROUP BY key),
    m AS (SELECT key, a, b, o FROM a FULL JOIN b USING (key) LEFT JOIN o USING (key)),
    r AS (SELECT key, a, b, CASE WHEN b IS NULL THEN 'ours' WHEN a IS NULL THEN 'theirs' WHEN a = b THEN 'both' WHEN o = a THEN 'theirs' WHEN o = b THEN 'ours' ELSE 'keep' END AS side FROM m)
    SELECT key, CASE WHEN side = 'theirs' THEN b ELSE a END AS digest, CASE side WHEN 'keep' THEN 'ours' ELSE side END AS side FROM r
    UNION ALL SELECT key || '__altra-copia', b, 'theirs' FROM r WHERE side = 'keep'""")
def cnv9_merge_stores(spark, d):
    return V.merge_stores(*digests(spark, d))


@query(r"SELECT page_id, left(sha256(CASE WHEN page_id % 3 = 0 THEN lower(url) WHEN page_id % 3 = 1 THEN 'media-id:m' || page_id ELSE 'c:/x/' || page_id END), 20) AS key, left(sha256('c:/x/' || page_id || ':msg:' || page_id % 5), 20) AS message_key FROM pages")
def cnv10_stable_keys(spark, d):
    path = F.concat(F.lit("C:/X/"), F.col("page_id").cast("string"))
    key = V.stable_key(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("M"), F.col("page_id").cast("string"))), path)
    return table(spark, d, "pages").select("page_id", key.alias("key"), V.message_key(path, F.col("page_id") % 5).alias("message_key"))


@query("WITH " + CHATS_SQL + r""", b AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Tu' ELSE 'Gemini' END || ':' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS b,
        arg_max('m' || turn % 5, turn) FILTER (WHERE role = 'model' AND turn % 4 <> 3) AS model FROM turns GROUP BY conv_id)
    SELECT conv_id, md5(title || chr(10) || strftime(updated, '%d/%m/%Y %H:%M') || coalesce(chr(10) || 'Modello: ' || model, '') || chr(10) || chr(10) || b) AS transcript_md5 FROM headers JOIN b USING (conv_id)""")
def cnv11_render_transcript(spark, d):
    """Transcripts of turns of which some tell their model."""
    turns, headers = chats(spark, d)
    model = F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("m"), (F.col("turn") % 5).cast("string")))
    return V.render_transcript(turns.withColumn("model", model), headers).select("conv_id", F.md5("transcript").alias("transcript_md5"))


@query("WITH " + CHATS_SQL + r""" SELECT conv_id::VARCHAR || '/' || t AS name, first_value(conv_id) OVER (PARTITION BY lower(t) ORDER BY conv_id % 4 = 0 DESC, updated DESC, conv_id) AS conv_id
    FROM (SELECT *, regexp_replace(title, '[/\\\n]', '_', 'g') AS t FROM headers)""")
def cnv12_match_export(spark, d):
    """Exports of all conversations; signs that no file name may hold are `_` in titles and names."""
    headers = chats(spark, d)[1].withColumn("title", F.regexp_replace("title", r"[/\\\n]", "_"))
    exports = headers.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), "title", F.lit(".chat.txt")).alias("name"))
    found = V.match_export(exports, headers.withColumn("current", F.col("conv_id") % 4 == 0))
    return found.withColumn("name", F.regexp_replace("name", r"\.chat\.txt$", ""))


# ---------------------------------------------------------------- incremental


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def str2_only_changed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    done = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").select(I.work_key(["doc_id", "n_chars"], "it", "1").alias("key"))
    return I.only_changed(docs, done, ["doc_id", "n_chars"], "it", "1").select("doc_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def str4_latest_per_key(spark, d):
    return I.latest_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE 'written' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk3_reports_if_absent(spark, d):
    return I.reports_if_absent(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
