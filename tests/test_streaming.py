"""Streams give what the batch operators give on the final table."""

from textquarry.operators.incremental import latest_per_key
from textquarry.operators.search import line_hits
from textquarry.streaming import arrivals as A

SCHEMA = "doc_id long, text string, src string"


def test_search_arrivals_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    first = spark.createDataFrame([(1, "uno\ngol qui", "a"), (2, "niente", "a")], SCHEMA)
    first.write.parquet(str(folder))
    rows = lambda: A.search_arrivals(A.arrivals(spark, str(folder), first.schema), ["gol"], ["src", "doc_id"])
    A.to_parquet(rows(), out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, "altro gol", "a")], SCHEMA).write.mode("append").parquet(str(folder))
    A.to_parquet(rows(), out, str(tmp_path / "cp")).awaitTermination()
    batch = line_hits(spark.read.parquet(str(folder)), "src", "doc_id", ["gol"])
    assert sorted(map(tuple, spark.read.parquet(out).select("src", "doc_id", "line_number", "snippet").collect())) == sorted(map(tuple, batch.collect()))


def test_standing_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "il gol", "a"), (2, "la rete", "a")], SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    profiles = spark.createDataFrame([("p", ["gol"]), ("q", ["RETE", "la"]), ("r", [])], "name string, terms array<string>")
    stream = A.standing_search(A.arrivals(spark, str(tmp_path / "in"), docs.schema), profiles, ["doc_id"])
    A.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("p", 1), ("q", 2)]


def test_latest(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, t int, v string")
    assert sorted(map(tuple, latest_per_key(rows, "key", "t", "v").collect())) == [("j", 1, "c"), ("k", 2, "b")]


def test_latest_of_changed_keys(spark, tmp_path):
    from textquarry.streaming import arrivals as A

    schema = "key string, t long, v string"
    for rows in ([("k", 1, "a"), ("j", 1, "x")], [("k", 2, "b")], [("k", 0, "old"), ("i", 5, "n")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = A.latest_stream(A.arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "key", "t", "v")
        A.latest_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert sorted(map(tuple, A.latest_table(spark, f"{tmp_path}/out", "key").collect())) == [("i", 5, "n"), ("j", 1, "x"), ("k", 2, "b")]


def test_profiles_that_change_between_batches(spark, tmp_path):
    docs = spark.createDataFrame([(k, "parola zeta" if k % 2 else "altro") for k in range(6)], "doc_id long, text string")
    profiles = lambda n, rows: spark.createDataFrame(rows, "name string, terms array<string>").selectExpr("*", f"{n} AS version")
    run = lambda: A.standing_to_table(A.arrivals(spark, f"{tmp_path}/in", docs.schema), lambda s: s.read.parquet(f"{tmp_path}/profiles"), ["doc_id"], f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    profiles(1, [("a", ["ZETA", "parola"]), ("b", ["altro"])]).write.parquet(f"{tmp_path}/profiles")
    docs.where("doc_id < 3").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    profiles(2, [("b", ["altro"]), ("c", ["parola"])]).write.mode("overwrite").parquet(f"{tmp_path}/profiles")
    docs.where("doc_id >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = sorted((r["name"], r["doc_id"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, 1), ("b", 0, 1), ("b", 2, 1), ("b", 4, 2), ("c", 3, 2), ("c", 5, 2)]


def test_a_log_of_latest_rows(spark, tmp_path):
    """A hundred batches: few folders to read, merges as one table would give, repeats change nothing, idle keys go."""
    import random

    for last in range(300):
        held = [n for level, to in A._cover(last, 4) for n in range(to - 4**level + 1, to + 1)]
        assert held == list(range(last + 1)) and len(A._cover(last, 4)) <= 3 * 5
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(12) if k < 80 else rng.randrange(4)}", k, f"v{k}") for k in range(100)]
    schema = spark.createDataFrame([], "key string, at timestamp, v string").schema
    table = lambda own: spark.createDataFrame(own, "key string, s long, v string").selectExpr("key", "timestamp_seconds(s) AS at", "v")

    puts = []

    class Writer:  # keeps what foreachBatch is given, to be called without a stream for each batch
        def __getattr__(self, name):
            return (lambda f: puts.append(f) or self) if name == "foreachBatch" else lambda *a, **b: self

    class Rows:
        writeStream = Writer()

        def __init__(self):
            self.schema = schema

    out = f"{tmp_path}/log"
    A.latest_to_log(Rows(), "key", "at", "v", out, "none", idle=15, fan=4)
    for n in range(37):
        part = rows[n * 2 : n * 2 + 2] if n < 36 else rows[72:]
        puts[0](table(part), n)
        if n % 5 == 3:
            puts[0](table(part), n)  # once more
    want = {}
    for key, s, v in rows:
        want[key] = (s, v)
    got = A.latest_log(spark, out, schema, "key", "at", "v").selectExpr("key", "unix_seconds(at) AS s", "v").collect()
    recent = {k: x for k, x in want.items() if x[0] >= 99 - 15}
    got = {r["key"]: (r["s"], r["v"]) for r in got}
    assert all(got[k] == x for k, x in recent.items()) and all(want[k] == x for k, x in got.items())
    kept = {r["key"] for r in A.latest_log(spark, out, schema, "key", "at", "v", idle=15).collect()}
    assert kept == set(recent)
    assert len(A.log_folders(spark, out)) <= 6 and sum(1 for _ in (tmp_path / "log").glob("level=*/to=*")) < 30
