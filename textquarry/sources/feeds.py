"""Feeds: RSS, Atom, CDF and RDF entries, and lists of feeds, through Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = T.StringType()


def _field(name: str, kind: T.DataType = TEXT) -> T.StructField:
    return T.StructField(name, kind)


def _tagged(*attributes: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([_field("_VALUE"), *[_field(f"_{a}") for a in attributes]]))


#: Elements of an entry in any of the formats. Those that may repeat, or have attributes, are lists.
ENTRY = T.StructType(
    [
        *[_field(n) for n in ("title", "description", "summary", "subtitle", "abstract", "id", "pubDate", "published", "issued", "updated", "modified", "lastBuildDate", "created", "expirationDate", "comments", "rights", "copyright", "language", "publisher", "webMaster")],
        *[_field(n) for n in ("dc:creator", "dc:date", "dc:title", "dc:description", "dc:rights", "dc:language", "dc:publisher", "dc:identifier", "content:encoded", "creativeCommons:license", "admin:generatorAgent", "admin:errorReportsTo")],
        _field("dc:subject", T.ArrayType(TEXT)),
        _field("guid", T.StructType([_field("_VALUE"), _field("_isPermaLink")])),
        _field("link", _tagged("href", "rel", "type", "title", "length")),
        _field("enclosure", _tagged("url", "type", "length")),
        _field("category", _tagged("term", "scheme", "domain", "label")),
        _field("keywords", T.ArrayType(TEXT)),
        _field("content", _tagged("type", "src", "mode")),
        _field("author", T.ArrayType(T.StructType([_field("_VALUE"), _field("name"), _field("email"), _field("uri")]))),
        _field("contributor", T.ArrayType(T.StructType([_field("_VALUE"), _field("name"), _field("email"), _field("uri")]))),
        *[_field(n) for n in ("georss:point", "georss:line", "georss:polygon", "georss:box", "geo:lat", "geo:long")],
        *[_field(n) for n in ("itunes:author", "itunes:subtitle", "itunes:summary", "itunes:duration", "itunes:explicit", "itunes:block", "itunes:keywords")],
        _field("itunes:image", T.StructType([_field("_href")])),
        _field("itunes:category", _tagged("text")),
        _field("media:content", _tagged("url", "type", "medium", "width", "height", "duration", "fileSize")),
        _field("media:thumbnail", _tagged("url", "width", "height")),
        _field("media:rating", T.StructType([_field("_VALUE"), _field("_scheme")])),
        _field("media:credit", _tagged("role", "scheme")),
        _field("media:restriction", T.StructType([_field("_VALUE"), _field("_relationship"), _field("_type")])),
        _field("media:license", T.StructType([_field("_VALUE"), _field("_href"), _field("_type")])),
        _field("media:player", T.StructType([_field("_VALUE"), _field("_url")])),
        _field("psc:chapters", T.StructType([_field("psc:chapter", T.ArrayType(T.StructType([_field("_VALUE"), _field("_start"), _field("_title"), _field("_href"), _field("_image")])))])),
        _field("_href"),
        _field("_lastmod"),
        _field("_rdf:about"),
        _field("_corrupt_record"),
    ]
)


def read_entries(spark: SparkSession, path: str, tags: tuple[str, ...] = ("item", "entry")) -> DataFrame:
    """Entries of all feeds below a path as they stand, with feed (the file) and bozo (the entry could not be read whole)."""
    out = None
    for tag in tags:
        rows = spark.read.format("xml").schema(ENTRY).option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").load(path)
        rows = rows.select(F.col("_metadata.file_path").alias("feed"), F.col("_corrupt_record").isNotNull().alias("bozo"), *[F.col(f"`{c}`") for c in rows.columns if c != "_corrupt_record"])
        out = rows if out is None else out.unionByName(rows)
    return out


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """feed, title, link, description, language, updated of each feed's head."""
    head = T.StructType([_field("title"), _field("description"), _field("subtitle"), _field("language"), _field("lastBuildDate"), _field("updated"), _field("pubDate"), _field("link", _tagged("href", "rel", "type"))])
    out = None
    for tag in ("channel", "feed"):
        rows = spark.read.format("xml").schema(head).option("rowTag", tag).load(path).select(F.col("_metadata.file_path").alias("feed"), "*")
        out = rows if out is None else out.unionByName(rows)
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("link", F.lit(0))["_VALUE"])
    return out.select("feed", "title", link.alias("link"), F.coalesce("description", "subtitle").alias("description"), "language", F.coalesce("lastBuildDate", "updated", "pubDate").alias("updated"))


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """url, title of the feeds of an outline file, nested ones too."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<outline\b([^>]*)>"), F.lit(1))).alias("t"))
    attr = lambda n: F.regexp_extract("t", rf"""(?i)(?:^|\s){n}\s*=\s*["']([^"']*)["']""", 1)
    return lines.select(F.replace(attr("xmlUrl"), F.lit("&amp;"), F.lit("&")).alias("url"), F.coalesce(F.nullif(attr("title"), F.lit("")), attr("text")).alias("title")).where("url <> ''")
