"""A corpus pipeline: five stages, each an operator over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textquarry.llm._shared import cut
from textquarry.llm.jaccard import near_duplicates_removed
from textquarry.llm.line_dedup import dedup_lines
from textquarry.llm.mixing import emit_mix
from textquarry.llm.packing import pack_sequences
from textquarry.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    Null and empty texts are scored by their shape, null ids and rows alike each by itself; without labels all stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs.select(*COLUMNS), labels).where("NOT toxic").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document before them holds; n_chars follows the text.

    No row goes: one whose lines all do has an empty text, as a null one has. Rows of one id are one document, rows without an id one that comes last; ties cannot be, since rows alike lose the same lines.
    """
    return dedup_lines(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) AS bigint) AS n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id, null ids last, then by the text's hash.

    Texts without words stay, each as it is; of rows alike in id and text one does.
    """
    return near_duplicates_removed(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document stands there as often as the mix takes it.

    Null text has no words, null source is a source of its own, null ids and ties are ordered by a hash of the text, rows alike get their own copies.
    """
    return emit_mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; null and empty texts are the end mark alone, null ids and rows alike are packed row by row."""
    # the executors' heaps are full of what earlier stages left, so workers remember a third
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=32 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # a classifier, random offsets and a tokenizer are beyond SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
