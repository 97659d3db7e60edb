"""What holds at a time, runs as state machines, and streams in several batches, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, quantiles, timeline
from ..streaming import ingest, state
from .catalogue import query
from .registry import table

_SEEN = """SELECT l_partkey, l_shipdate AS seen_at, arg_max({'lat': l_suppkey % 180 - 90, 'lon': l_extendedprice}, l_orderkey * 10 + l_linenumber) AS place
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"""


@query("places_as_of", f"""
WITH seen AS ({_SEEN}) SELECT l_orderkey, l_linenumber, place.lat AS lat, place.lon AS lon, seen_at
FROM (SELECT * FROM lineitem WHERE l_returnflag = 'N') n ASOF LEFT JOIN seen s ON n.l_partkey = s.l_partkey AND n.l_shipdate >= s.seen_at""")
def places_as_of(spark, d):
    """Each open line's place as it was last seen when the line was shipped; a line returned is where a part was seen."""
    lines = table(spark, d, "lineitem")
    seen = lines.where("l_returnflag = 'R'").select("l_partkey", F.col("l_shipdate").alias("seen_at"), (F.col("l_suppkey") % 180 - 90).alias("lat"), F.col("l_extendedprice").alias("lon"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    asked = lines.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    met = timeline.as_of(asked, seen, ["l_partkey"], "l_shipdate", "seen_at", ["lat", "lon", "seen_at"], [F.col("n")], slice_seconds=86400 * 180)
    return met.select("l_orderkey", "l_linenumber", "lat", "lon", "seen_at")


@query("appended_places", """
WITH known AS (SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
found AS (SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_partkey, found.place FROM found LEFT JOIN known USING (l_partkey) WHERE found.place IS DISTINCT FROM known.place""")
def appended_places(spark, d):
    n, lines = F.col("l_orderkey") * 10 + F.col("l_linenumber"), table(spark, d, "lineitem")
    known = lines.where("l_returnflag = 'R'").select("l_partkey", F.col("l_suppkey").alias("place"), n.alias("at"))
    found = lines.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max_by("l_suppkey", n).alias("place"))
    return timeline.appended_places(known, found, "l_partkey", "at", ["place"])


_SAID = {"signup": "queue", "view": "start", "click": "heartbeat", "purchase": "finish", "error": "fail"}


def _moves_sql() -> str:
    return ", ".join(f"('{said}', '{a}', '{b}')" for said, event in _SAID.items() for a, b in timeline.RUN.events[event].items())


@query("run_states", f"""
WITH RECURSIVE moves(said, a, b) AS (VALUES {_moves_sql()}), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run(user_id, n, event_id, before, after, refused) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'idle', false FROM e
  UNION ALL SELECT e.user_id, e.n, e.event_id, run.after, coalesce(b, run.after), b IS NULL FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1 LEFT JOIN moves ON said = event_type AND a = run.after)
SELECT user_id, event_id, before, after, refused FROM run WHERE n > 0""")  # fmt: skip
def run_states(spark, d):
    said = F.col("event_type")
    event = F.coalesce(*[F.when(said == k, v) for k, v in _SAID.items()], F.lit("other"))
    events = table(spark, d, "events").select("user_id", "ts", "event_id", event.alias("event"))
    return timeline.folded(events, ["user_id"], "ts", "event_id", "event", timeline.RUN, slice_seconds=86400 * 5).select("user_id", "event_id", "before", "after", "refused")


def in_batches(spark: SparkSession, rows: DataFrame, order: str, home: str, batches: int) -> DataFrame:
    """rows as a stream of so many batches in order: written as files one after another, by shares of their order."""
    ends = rows.select(F.percentile_approx(F.col(order).cast("timestamp").cast("double"), [n / batches for n in range(1, batches)], 10_000).alias("p")).first().p or []
    at, folder = F.col(order).cast("timestamp").cast("double"), f"{home}/in"
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = rows.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.coalesce(1).write.mode("append").parquet(folder)
    return ingest.read_files(spark, folder, rows.schema)


def _home(spark: SparkSession, name: str) -> str:
    return f"{components.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("streamed_state", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def streamed_state(spark, d):
    """The last event of each user, kept as bucketed state while the events come in four batches."""
    home, columns = _home(spark, "state"), ["event_id", "event_type", "value"]
    events = table(spark, d, "events").select("user_id", *columns, "ts")
    run = ingest.upsert_stream(in_batches(spark, events, "ts", home, 4), f"{home}/state", f"{home}/checkpoint", "user_id", "event_id", columns)
    run.awaitTermination()
    return state.BucketState(spark, f"{home}/state", events.select("user_id", *columns).schema, "user_id").read()


LIMIT, SECONDS = 3, 6 * 3600


@query("limited_requests", f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run(user_id, n, event_id, log, answer) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::TIMESTAMP[], NULL::VARCHAR FROM e
  UNION ALL SELECT user_id, n, event_id, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, ts) ELSE kept END, CASE WHEN len(kept) < {LIMIT} THEN 'passed' ELSE 'refused' END
  FROM (SELECT e.user_id, e.n, e.event_id, e.ts, list_filter(run.log, lambda x: e.ts - x < INTERVAL {SECONDS} SECOND) AS kept FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1))
SELECT user_id, event_id, answer FROM run WHERE n > 0""")  # fmt: skip
def limited_requests(spark, d):
    """A limiter over the events as a stream in three batches; what it answers is read when the stream has ended."""
    home = _home(spark, "limited")
    stream = in_batches(spark, table(spark, d, "events").select("user_id", "event_id", "ts"), "ts", home, 3)
    answers = ingest.limited(stream, "user_id", "event_id", "ts", LIMIT, SECONDS, late_seconds=86400, idle_seconds=86400)
    ingest.write_limited(answers, f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema(answers.schema).parquet(f"{home}/out")


@query("daily_latencies", """
WITH r AS (SELECT ts::DATE AS day, value, row_number() OVER (PARTITION BY ts::DATE ORDER BY value) AS rn, count(*) OVER (PARTITION BY ts::DATE) AS n FROM events WHERE value IS NOT NULL),
h AS (SELECT day, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT day, max(value) FILTER (rn = ceil(0.5 * n)) AS p50, max(value) FILTER (rn = ceil(0.95 * n)) AS p95, max(value) FILTER (rn = n) AS worst, histogram FROM r JOIN h USING (day) GROUP BY day, histogram""")  # fmt: skip
def daily_latencies(spark, d):
    """Nearest ranks of a day from the sketches of its hours, and how often each status came."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value", "event_type")
    days = quantiles.merged(quantiles.sketches(e, ["day", "hour"], "value"), ["day"])
    ranks = quantiles.nearest_ranks(e, ["day"], "value", [0.5, 0.95, 1.0], days)
    wide = ranks.groupBy("day").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.5, "p50"), (0.95, "p95"), (1.0, "worst"))])
    said = F.array_join(F.transform(F.map_entries("histogram"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return wide.join(quantiles.histogram(e, ["day"], "event_type").select("day", said.alias("histogram")), "day")
