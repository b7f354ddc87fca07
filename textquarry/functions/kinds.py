"""File kinds by extension, as a small dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import extension

#: Extensions of each kind.
KINDS = {
    "image": ("jpg", "jpeg", "jfif", "png", "gif", "webp", "bmp", "tif", "tiff", "ico"),
    "audio": ("mp3", "m4a", "m4b", "aac", "flac", "ogg", "opus", "wav", "wma", "aif", "aiff", "mka"),
    "video": ("mp4", "m4v", "mkv", "avi", "mov", "wmv", "webm", "flv", "mts", "m2ts", "mpg", "mpeg", "3gp"),
    "document": ("txt", "log", "csv", "md", "rtf", "html", "htm", "docx", "doc", "odt", "xlsx", "pdf", "epub"),
}
WORDS = {"image": "Immagine", "audio": "Audio", "video": "Video", "document": "Documento"}


def kinds(spark: SparkSession) -> DataFrame:
    """ext, kind: one row per known extension, a table of fixed size."""
    return spark.createDataFrame([(e, k) for k, own in KINDS.items() for e in own], "ext string, kind string")


def kind_of(name: Column) -> Column:
    """image, audio, video, document, or empty."""
    ext = extension(name)
    found = F.lit("")
    for kind, own in KINDS.items():
        found = F.when(ext.isin(*own), kind).otherwise(found)
    return found


def type_label(name: Column) -> Column:
    """`Video MP4`, `Documento PDF`; a plain word without an extension."""
    kind, word = kind_of(name), F.lit("File")
    for k, w in WORDS.items():
        word = F.when(kind == k, w).otherwise(word)
    return F.when(extension(name) != "", F.concat(word, F.lit(" "), F.upper(extension(name)))).otherwise(word)
