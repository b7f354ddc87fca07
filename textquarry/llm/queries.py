"""The registered queries of the numbered operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import conversation_trie
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .line_dedup import dedup_lines
from .media import read_media, store_media
from .mixing import mix_sources
from .packing import pack_sequences
from .quality import score_quality
from .scoring import backoff_scores
from .sketching import sketch_components
from .spelling import spelling_variants
from .tokens import token_counts
from .toxicity import score_toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), weights=(5.0, 2.0, 1.0), most=3.0)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=5, percent=80)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_media(store_media(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    files = F.array_join(F.transform("media", F.hex), "")
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.aggregate("media", F.lit(0).cast("long"), lambda n, f: n + F.octet_length(f)).alias("media_bytes"),
        F.sha2(F.unhex(files), 256).alias("media_sha256"),
        "feature",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.drop("text")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(documents(spark, sf_dir), order=2, backoff=0.4, least=2)
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op11_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_components(documents(spark, sf_dir), n=3, percent=85)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), letters=6, least=5, ratio=5, slip=199)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=5, heads=9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_media_columns": op5_media_columns,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_lm_scores": op10_lm_scores,
    "op11_sketch_near_duplicates": op11_sketch_near_duplicates,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), ranked AS (
            SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                   row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS turn
            FROM norm
        )
        SELECT doc_id, keep_id, group_size, turn = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "op6_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM split
        ), keyed AS (
            SELECT doc_id, line, no,
                   translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), held AS (
            SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ), marked AS (
            SELECT k.*, h.first_doc IS NOT NULL AND k.doc_id <> h.first_doc AS gone
            FROM keyed k LEFT JOIN held h USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * s.n >= 80 * (p.n + q.n - s.n)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
    """,
    "op10_lm_scores": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), places AS (
            SELECT doc_id, unnest(w) AS word, unnest([NULL] || w[:-2]) AS context FROM words WHERE len(w) > 0
        ), one AS (SELECT word, count(*) AS n FROM places GROUP BY word),
        two AS (SELECT context, word, count(*) AS n FROM places WHERE context IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
        scored AS (
            SELECT doc_id, CASE WHEN p.context IS NULL THEN ln(o.n / (SELECT count(*) FROM places))
                WHEN t.n IS NOT NULL THEN ln(t.n) - ln(c.n)
                ELSE ln(0.4) + ln(o.n / (SELECT count(*) FROM places)) END AS s
            FROM places p JOIN one o ON o.word = p.word LEFT JOIN one c ON c.word = p.context
            LEFT JOIN two t ON t.context = p.context AND t.word = p.word
        )
        SELECT doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score,
               round(sum(s) / nullif(count(s), 0), 6) AS mean_log_score
        FROM documents LEFT JOIN scored USING (doc_id) GROUP BY doc_id
    """,
    "op11_sketch_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
    """,
}
