"""Keyed state, history, retries, retention and rates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money
from ..operators import documents, dossier, history, upsert
from .catalogue import query
from .registry import table

CUT = "2024-01-15 00:00:00"


def cut():
    return F.lit(CUT).cast("timestamp_ntz")


def snapshots(spark, d):
    """The last event of each user before the cut, and of all days."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    late = lambda df: history.latest(df, ["user_id"], F.col("ts"), F.col("event_id"))
    return late(e.where(F.col("ts") < cut())), late(e.where(F.col("ts") >= cut()))


SNAPSHOTS_SQL = f"""
a AS (SELECT * FROM events WHERE ts < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query("upsert_counters", f"""
WITH {SNAPSHOTS_SQL}
SELECT CASE WHEN a.user_id IS NULL THEN 'inserted' WHEN b.user_id IS NULL THEN 'missing' WHEN a.event_type IS NOT DISTINCT FROM b.event_type THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id GROUP BY 1""")
def upsert_counters(spark, d):
    a, b = snapshots(spark, d)
    return upsert.changes(a, b, "user_id", ["event_type"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_merge_policy", f"""
WITH {SNAPSHOTS_SQL}
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.ts, a.ts) AS ts, coalesce(b.value, a.value) AS value,
 CASE WHEN nullif(a.event_type, '') IS NULL AND NOT coalesce(a.value > 50, false) THEN b.event_type ELSE a.event_type END AS event_type, a.value > 50 AS locked
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def upsert_merge_policy(spark, d):
    a, b = (x.select("user_id", "ts", "value", "event_type", (F.col("value") > 50).alias("locked")) for x in snapshots(spark, d))
    return upsert.merge(a, b, "user_id", always=["ts", "value"], fill=["event_type"], locked="locked")


@query("missing_two_runs", """
WITH days AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') * 4 < count(*) AS complete FROM events GROUP BY 1),
last AS (SELECT user_id, max(day) AS last_seen FROM (SELECT user_id, ts::DATE AS day FROM events) JOIN days USING (day) WHERE complete GROUP BY 1)
SELECT user_id, last_seen, (SELECT count(*) FROM days WHERE complete AND day > last_seen) AS missed FROM last WHERE (SELECT count(*) FROM days WHERE complete AND day > last_seen) >= 2""")
def missing_two_runs(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    runs = e.groupBy("day").agg((F.count_if(F.col("event_type") == "error") * 4 < F.count(F.lit(1))).alias("complete"))
    return history.absent_runs(e.select("user_id", "day"), runs, "user_id", "day")


@query("status_history", """
SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR previous IS DISTINCT FROM event_type""")
def status_history(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return history.transitions(e, ["user_id"], "event_type", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "previous")


@query("status_ranges", """
WITH t AS (SELECT * FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR previous IS DISTINCT FROM event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM t""")
def status_ranges(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return history.valid_ranges(e, ["user_id"], "event_type", "ts", F.col("event_id")).select("user_id", "event_type", "valid_from", "valid_to")


@query("archive_closed", f"""
SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 10 = 0 AS is_archived, CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN TIMESTAMP '{CUT}' END AS archived_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN TIMESTAMP '{CUT}' END AS closed_at FROM orders""")
def archive_closed(spark, d):
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    lots = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("auction_status"), F.when(key % 10 == 0, True).alias("is_archived"), F.when(key % 20 == 0, at).alias("archived_at"), F.when(key % 3 == 0, at).alias("closed_at"))
    return dossier.archived(lots, cut()).drop("auction_status")


@query("document_versions", "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def document_versions(spark, d):
    return documents.versions(table(spark, d, "documents"), "text", "doc_id")


@query("document_diff", """
SELECT source, doc_id, previous, changed, size_change FROM (SELECT source, doc_id, lag(doc_id) OVER w AS previous, lag(sha256(text)) OVER w <> sha256(text) AS changed, n_chars - lag(n_chars) OVER w AS size_change
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE previous IS NOT NULL""")
def document_diff(spark, d):
    return documents.differences(table(spark, d, "documents"), "source", "doc_id", "text", "n_chars")


@query("payload_retention", f"SELECT count(*) AS total, count(*) FILTER (WHERE ts < TIMESTAMP '{CUT}' - INTERVAL 7 DAYS AND props IS NOT NULL) AS cleared, count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}' - INTERVAL 7 DAYS AND props IS NOT NULL) AS kept FROM events")
def payload_retention(spark, d):
    e = table(spark, d, "events").withColumn("given", F.col("props"))
    kept = documents.retained(e, "props", F.col("ts"), cut(), 7)
    return kept.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("props").isNull() & F.col("given").isNotNull()).alias("cleared"), F.count("props").alias("kept"))


@query("watchlist_toggle", "SELECT user_id, count(*) AS toggles FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) % 2 = 1")
def watchlist_toggle(spark, d):
    return history.toggled_on(table(spark, d, "events").where("event_type = 'click'"), ["user_id"])


@query("last_write_wins", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark, d):
    return upsert.last_write(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value")


FAILURES_SQL = f"SELECT user_id, count(*) AS attempts, max(ts) AS last_failure, least(300 * pow(2, count(*) - 1), 3600)::DOUBLE AS backoff_s, count(*) >= 8 AS terminal FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{CUT}' GROUP BY 1"


def failures(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") < cut()))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_failure"))
    return n.withColumn("backoff_s", money.backoff_seconds("attempts", 300, 3600)).withColumn("terminal", F.col("attempts") >= 8)


@query("retry_queue", f"SELECT *, NOT terminal AND last_failure + to_seconds(backoff_s) <= TIMESTAMP '{CUT}' AS due FROM ({FAILURES_SQL})")
def retry_queue(spark, d):
    f = failures(spark, d)
    due = F.unix_micros(F.col("last_failure").cast("timestamp")) + F.col("backoff_s") * 1_000_000 <= F.unix_micros(cut().cast("timestamp"))
    return f.withColumn("due", ~F.col("terminal") & due)


@query("pending_backfill", f"""
SELECT c_custkey, attempts, backoff_s FROM customer LEFT JOIN ({FAILURES_SQL}) f ON c_custkey = f.user_id WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')""")
def pending_backfill(spark, d):
    bought = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(bought, "c_custkey", "left_anti").join(failures(spark, d).withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left").select("c_custkey", "attempts", "backoff_s")


@query("rate_tumbling", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def rate_tumbling(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("rate_sliding", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def rate_sliding(spark, d):
    return history.sliding_count(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "n_recent")


@query("recent_logs", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def recent_logs(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("event_id", "user_id", "event_type")


@query("stuck_runs", f"SELECT user_id, max(ts) AS started FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTES")
def stuck_runs(spark, d):
    from ..functions import dates

    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("started"))
    return last.where(dates.stuck(F.col("started"), F.col("started"), F.lit("2024-01-30 00:00:00")))
