"""Registered queries of streams: the given tables replayed to the end, with the SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import arrivals as A
from ._tables import shared_folder, table


def finished(spark, rows, name):
    """All that a stream appends, when its source has no more."""
    out = shared_folder(spark, name)
    A.to_parquet(rows, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def str1_search_arrivals(spark, d):
    docs = A.arrivals(spark, f"{d}/document[s].parquet", table(spark, d, "documents").schema)
    return finished(spark, A.search_arrivals(docs, ["the", "and"], ["doc_id"]), "arrivals")


def str3_standing_search(spark, d):
    """Saved profiles, a table that every batch reads anew, over arriving documents."""
    docs = A.arrivals(spark, f"{d}/document[s].parquet", table(spark, d, "documents").schema)
    out = shared_folder(spark, "standing")
    table(spark, d, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("name"), F.slice(F.split("text", " "), 1, 2).alias("terms")).write.parquet(f"{out}-profiles")
    A.standing_to_table(docs.select("doc_id", "text"), lambda s: s.read.parquet(f"{out}-profiles"), ["doc_id"], out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("name", "doc_id")


def str4_latest_stream(spark, d):
    """Events in batches of a file each, as a log of newest rows."""
    out = shared_folder(spark, "latest")
    columns = ["user_id", "ts", "event_id", "event_type"]
    table(spark, d, "events").select(*columns).repartitionByRange(20, "ts").write.parquet(f"{out}-events")
    schema = table(spark, d, "events").select(*columns).schema
    rows = A.arrivals(spark, f"{out}-events", schema, files_per_batch=1)
    A.latest_to_log(rows, "user_id", "ts", "event_id", out, f"{out}-checkpoint", fan=4).awaitTermination()
    return A.latest_log(spark, out, schema, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (str1_search_arrivals, str3_standing_search, str4_latest_stream)}
ORACLE_SQL = {
    "str1_search_arrivals": r"""
        WITH hits AS (
            SELECT doc_id, string_split(text, chr(10)) AS l,
                   list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: contains(lower(string_split(text, chr(10))[i]), 'the') AND contains(lower(string_split(text, chr(10))[i]), 'and'))[1] AS n
            FROM documents)
        SELECT doc_id, n::INT AS line_number, trim(array_to_string(list_transform(l[greatest(1, n - 2):n + 2], lambda x: trim(x)), ' ')) AS snippet FROM hits WHERE n IS NOT NULL""",
    "str3_standing_search": r"""
        SELECT 'p' || item_id AS name, doc_id FROM (SELECT item_id, lower(string_split(text, ' ')[1]) AS a, lower(string_split(text, ' ')[2]) AS b FROM benchmark)
        JOIN documents d ON contains(lower(d.text), a) AND contains(lower(d.text), b)""",
    "str4_latest_stream": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
}
