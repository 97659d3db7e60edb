"""Operators on small frames: upserts, absences, resolution, streams."""

import datetime as dt

from pyspark.sql import functions as F

from lotwright.operators import documents, history, resolve, upsert
from lotwright.streaming import ingest, state


def test_same_page_twice_is_unchanged(spark):
    page = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, price double")
    none = page.limit(0)
    count = lambda x, y: {r.change: r.n for r in upsert.changes(x, y, "id", ["price"]).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count(none, page) == {"inserted": 2} and count(page, page) == {"unchanged": 2}
    assert count(page, page.withColumn("price", F.lit(2.0))) == {"updated": 2}


def test_locked_rows_take_only_price(spark):
    state = spark.createDataFrame([("a", 1.0, "", True), ("b", 1.0, "", False)], "id string, price double, address string, locked boolean")
    new = spark.createDataFrame([("a", 2.0, "x", None), ("b", None, "y", None), ("c", 3.0, "z", False)], state.schema)
    got = {r.id: (r.price, r.address) for r in upsert.merge(state, new, "id", ["price"], ["address"], "locked").collect()}
    assert got == {"a": (2.0, ""), "b": (1.0, "y"), "c": (3.0, "z")}


def test_two_complete_runs_without_a_key_archive_it(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "id string, run int")
    runs = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "run int, complete boolean")
    assert {(r.id, r.missed) for r in history.absent_runs(seen, runs, "id", "run").collect()} == {("a", 2)}


def test_transitions_and_ranges(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y"), ("k", 4, None), ("k", 5, None)], "k string, t int, s string")
    assert [(r.t, r.previous) for r in history.transitions(df, ["k"], "s", F.col("t")).orderBy("t").collect()] == [(1, None), (3, "x"), (4, "y")]
    assert [(r.valid_from, r.valid_to) for r in history.valid_ranges(df, ["k"], "s", "t").orderBy("t").collect()] == [(1, 3), (3, 4), (4, None)]


def test_new_document_versions(spark):
    known = spark.createDataFrame([(1, "a")], "doc int, text string").withColumn("sha256", F.sha2("text", 256))
    got = documents.new_versions(known, spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "doc int, text string"), "doc", "text").collect()
    assert sorted((r.doc, r.text) for r in got) == [(1, "b"), (2, "a")]


def lots(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, identifiers array<string>, price double, address string, title string, region string")


def test_pairs(spark):
    df = lots(spark, [
        (1, "a", ["76:1"], 100.0, "", "", ""), (2, "b", ["76:1"], 104.0, "", "", ""), (3, "c", ["76:1"], 200.0, "", "", ""), (4, "A", ["76:1"], 100.0, "", "", ""),
        (5, "a", [], 24356.42, "Рязань улица Мира 12", "", ""), (6, "b", [], 24356.42, "улица Мира 12", "", ""),
        (7, "a", [], 5e6, "", "Нежилое здание на улице Мира", "r"), (8, "b", [], 5e6 + 4000, "", "Нежилое здание на улице Мира.", "r"), (9, "b", [], 5e6, "", "Нежилое здание на улице Мира", "q"),
    ])
    assert {tuple(r) for r in resolve.pairs(df).collect()} == {(1, 2), (2, 4), (5, 6), (7, 8)}


def test_band_join_is_the_theta_join(spark):
    import random

    rnd = random.Random(1)
    values = [rnd.choice([rnd.uniform(0, 5), rnd.uniform(900, 1100), rnd.uniform(1e6, 1.01e6)]) for _ in range(120)]
    l = spark.createDataFrame(list(enumerate(values)), "a int, x double")
    got = {tuple(r) for r in resolve.band_join(l, l.select(F.col("a").alias("b"), F.col("x").alias("y")), "x", "y").select("a", "b").collect()}
    rows = resolve.band_join(l, l.select(F.col("a").alias("b"), F.col("x").alias("y")), "x", "y").count()
    want = {(i, j) for i, p in enumerate(values) for j, q in enumerate(values) if abs(p - q) <= max(1, min(p, q) * 0.001)}
    assert got == want and rows == len(want)


def test_stars_are_those_of_the_scan(spark):
    import random

    rnd = random.Random(2)
    edges = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(90)) if a < b}
    primary = {}
    for i in sorted({x for e in edges for x in e}):
        first = min((a for a, b in edges if b == i and primary.get(a) == a), default=i)
        primary[i] = first
    got = {r.id: r.primary for r in resolve.stars(spark.createDataFrame(sorted(edges), "left long, right long")).collect()}
    assert got == primary


def test_survivors_fill_blanks(spark):
    rows = spark.createDataFrame([(1, "", 5), (2, "x", 6), (3, "y", 7)], "id long, address string, n int")
    ties = spark.createDataFrame([(1, 1), (2, 1)], "id long, primary long")
    assert sorted(tuple(r) for r in resolve.survivors(rows, ties, ["address"]).select("id", "address", "n", "n_sources").collect()) == [(1, "x", 5, 2), (3, "y", 7, 1)]


def test_upsert_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, i, f"s{i % 3}") for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "k int, t int, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_files(spark, str(tmp_path / "in"), "k int, t int, s string")
    q = ingest.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "k", "t", ["t", "s"])
    q.awaitTermination(120)
    kept = state.BucketState(spark, str(tmp_path / "state"), stream.schema, "k")
    assert kept.versions() == [0, 1, 2, 3]
    got = {r.k: (r.t, r.s) for r in kept.read().collect()}
    assert got == {k: (t, s) for k, t, s in rows}
    counts = spark.read.parquet(str(tmp_path / "state-counts" / "0")).collect()
    assert [(r.change, r.n) for r in counts] == [("inserted", 7)]


def test_rate_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [(i, "u", at(s)) for i, s in enumerate([0, 10, 20, 59, 60, 61, 200])]
    spark.createDataFrame(rows, "id long, u string, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    source = lambda: ingest.read_files(spark, str(tmp_path / "in"), "id long, u string, ts timestamp_ntz")
    assert sorted(r.n for r in run(ingest.tumbling_rates(source(), "u", "ts"), "complete", "tumbling")) == [1, 2, 4]
    passed = {r.id: r.passed for r in run(ingest.accepted(source(), "u", "id", "ts", 3), "append", "limited")}
    assert passed == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
