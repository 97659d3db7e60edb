"""As-of joins, state machines, bucketed state and the limiter, against brute force."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import history, timeline
from lotwright.streaming import ingest, state


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("seconds", [None, 600, 7])
def test_as_of_is_the_last_row_before(spark, seconds):
    rnd = random.Random(4)
    right = [(rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice([at(rnd.randint(0, 90)), None]) if rnd.random() < 0.1 else at(rnd.randint(0, 90)), n) for n in range(200)]
    left = [(n, rnd.choice(["a", "b", "c", "hot", "hot", None]), None if rnd.random() < 0.05 else at(rnd.randint(-5, 95))) for n in range(200)]
    r = spark.createDataFrame(right, "k string, seen timestamp_ntz, v int")
    l = spark.createDataFrame(left, "id int, k string, asked timestamp_ntz")
    got = {x.id: x.v for x in timeline.as_of(l, r, ["k"], "asked", "seen", ["v"], slice_seconds=seconds).collect()}
    want = {i: max(((s, v) for q, s, v in right if q == k and k and s and t and s <= t), default=(None, None))[1] for i, k, t in left}
    assert got == want and any(v is not None for v in want.values())
    assert timeline.as_of(l.limit(0), r, ["k"], "asked", "seen", ["v"], slice_seconds=seconds).count() == 0
    assert {x.v for x in timeline.as_of(l, r.limit(0), ["k"], "asked", "seen", ["v"], slice_seconds=seconds).collect()} == {None}


def test_as_of_makes_no_pairs(spark):
    """A key with all rows: what a join would pair is a million, what is sorted is both sides."""
    l = spark.range(1000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("asked"), "id")
    plan = timeline.as_of(l, l.select("k", F.col("asked").alias("seen"), F.col("id").alias("v")), ["k"], "asked", "seen", ["v"])
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.where("v <> id").count() == 0


def test_places_are_appended_when_they_change(spark):
    known = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 1, 5.0)], "k string, at int, lat double")
    found = spark.createDataFrame([("a", 3, 6.0), ("b", 3, 7.0), ("c", 3, 1.0), ("d", 3, None)], "k string, at int, lat double")
    assert sorted(r.k for r in timeline.appended_places(known, found, "k", "at", ["lat"]).collect()) == ["b", "c"]


@pytest.mark.parametrize("seconds", [None, 3600, 60])
def test_folded_runs(spark, seconds):
    rnd = random.Random(6)
    events = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), at(rnd.randint(0, 600)), n, rnd.choice(["queue", "start", "heartbeat", "finish", "fail", "odd", None])) for n in range(400)]
    df = spark.createDataFrame(events, "run string, at timestamp_ntz, id int, event string")
    got = {r.id: (r.before, r.after, r.refused) for r in timeline.folded(df, ["run"], "at", "id", "event", timeline.RUN, slice_seconds=seconds).collect()}
    now, want = {}, {}
    for run, _, n, event in sorted(events, key=lambda e: (e[1], e[2])):
        before = now.get(run, "idle")
        to = timeline.RUN.events.get(event, {}).get(before)
        want[n] = (before, to or before, to is None)
        now[run] = to or before
    assert got == want and {w[1] for w in want.values()} == set(timeline.RUN.states)


def test_machines_name_their_states():
    with pytest.raises(ValueError):
        timeline.Machine(("a",), {"x": {"a": "b"}})


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_a_version_writes_the_buckets_that_it_meets(spark, tmp_path):
    base = str(tmp_path / "state")
    first = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    kept = state.BucketState(spark, base, first.schema, "k", 40)
    newest = lambda before, fresh: history.latest(before.unionByName(fresh), ["k"], F.col("t"))
    kept.write(0, first, newest)
    kept.write(1, spark.createDataFrame([(7, 1, "x"), (8, 1, "y"), (9000, 1, "z")], first.schema), newest)
    assert _bytes(f"{base}/data/1") < 0.15 * _bytes(f"{base}/data/0")
    want = {k: 0 for k in range(4000)} | {7: 1, 8: 1, 9000: 1}
    assert {r.k: r.t for r in kept.read().collect()} == want
    assert {r.k: r.t for r in kept.read(0).collect()} == {k: 0 for k in range(4000)}
    # A version that failed before its pointers is as if never begun; written again it replaces itself.
    kept.write(2, spark.createDataFrame([(8, 2, "q")], first.schema), newest)
    os.remove(f"{base}/versions/2/_SUCCESS")
    assert kept.versions() == [0, 1] and {r.k: r.t for r in kept.read().collect()} == want
    kept.write(2, spark.createDataFrame([(8, 3, "q")], first.schema), newest)
    kept.write(2, spark.createDataFrame([(8, 3, "q")], first.schema), newest)
    assert {r.k: r.t for r in kept.read().collect()} == want | {8: 3}
    size = _bytes(base)
    kept.forget(keep=1)
    assert {r.k: r.t for r in kept.read().collect()} == want | {8: 3} and kept.versions() == [2] and _bytes(base) < size


def test_limiter_over_batches_with_late_requests(spark, tmp_path):
    rows = [(1, "u", at(0)), (2, "u", at(1)), (3, "u", at(2)), (4, "v", at(0))], [(5, "u", at(3)), (6, "u", at(61)), (7, "v", at(400))], [(8, "v", at(100)), (9, "v", at(399)), (10, "u", at(62)), (11, "u", at(63))]
    for part in rows:
        spark.createDataFrame(part, "id long, who string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_files(spark, str(tmp_path / "in"), "id long, who string, ts timestamp_ntz")
    answers = ingest.limited(stream, "who", "id", "ts", limit=2, seconds=3600, late_seconds=1800, idle_seconds=7200)
    ingest.write_limited(answers, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.id: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "passed", 2: "passed", 3: "refused", 4: "passed", 5: "refused", 6: "passed", 7: "passed", 8: "late", 9: "passed", 10: "passed", 11: "refused"}
    with pytest.raises(ValueError):
        ingest.limited(stream, "who", "id", "ts", 2, seconds=60, idle_seconds=1)
