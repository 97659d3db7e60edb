"""Quality counters, imports, retries, lookups and a streamed ingest over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import history, links, listing, quality, resolve, upsert
from ..streaming import ingest, state
from .catalogue import query
from .registry import table
from .state import CUT, FAILURES_SQL, SNAPSHOTS_SQL, cut, failures, snapshots


@query("quality_counters", """
SELECT count(*) AS total_lots, count(*) FILTER (o_orderstatus = 'O') AS active_lots, count(*) FILTER (o_orderstatus = 'F') AS archived_lots, count(*) FILTER (o_orderkey % 10 = 0) AS duplicate_lots,
  count(*) FILTER (o_orderpriority LIKE '5%') AS missing_address, count(*) FILTER (o_custkey % 4 = 0) AS missing_cadastre, count(*) FILTER (o_orderkey % 15 = 0) AS missing_price,
  count(*) FILTER (o_custkey % 2 = 0) AS geo_attention_lots, count(*) FILTER (o_orderstatus = 'P') AS unknown_status_lots, count(*) FILTER (o_orderkey % 7 = 0) AS ai_analyzed_lots,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS geocoded_lots, (SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click')) AS queued_geo_failures, (SELECT count(*) FROM documents) AS document_versions
FROM orders""")  # fmt: skip
def quality_counters(spark, d):
    key, status, none = F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None).cast("string")
    lots = table(spark, d, "orders").select(
        F.when(status == "O", "active").when(status == "P", "unknown").otherwise("closed").alias("status"), (status == "F").alias("archived"), F.when(key % 10 == 0, key).alias("duplicate_of"),
        F.when(F.col("o_orderpriority").startswith("5"), " ").otherwise("x").alias("address"), F.when(F.col("o_custkey") % 4 != 0, "x").alias("cadastral_number"), F.when(key % 5 != 0, 1.0).alias("current_price"),
        F.when(key % 3 != 0, 1.0).alias("start_price"), (F.col("o_custkey") % 2 == 0).alias("needs_geo_check"), F.when(key % 7 == 0, 1.0).alias("market_price"), none.alias("advice"),
    )
    kind = F.col("event_type")
    failed = table(spark, d, "events").select(F.when(kind == "view", "resolved").when(kind == "click", "terminal").otherwise(kind).alias("status"))
    return quality.snapshot(lots, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lot_id")), failed, table(spark, d, "documents"))


@query("copy_reconcile", """
SELECT o_orderstatus, count(*) AS source_rows, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS target_rows,
  count(*) = count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS matches
FROM orders GROUP BY 1""")  # fmt: skip
def copy_reconcile(spark, d):
    orders = table(spark, d, "orders")
    copied = orders.join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return quality.reconcile(orders, copied, ["o_orderstatus"])


@query("status_observations", f"""
WITH {SNAPSHOTS_SQL}
SELECT b.user_id, b.event_type, a.event_type AS previous FROM b LEFT JOIN a ON a.user_id = b.user_id WHERE b.event_type IS NOT NULL AND a.event_type IS DISTINCT FROM b.event_type""")
def status_observations(spark, d):
    known, seen = snapshots(spark, d)
    return history.observations(known, seen.select("user_id", "event_type"), "user_id", "event_type")


@query("import_counters", """
WITH fresh AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS key, o_orderstatus AS status FROM orders), once AS (SELECT key, min(status) AS status FROM fresh WHERE key IS NOT NULL GROUP BY 1),
known AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS status FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT count(*) FILTER (k.key IS NULL) AS new, count(*) FILTER (k.status <> o.status) AS updated FROM once o LEFT JOIN known k ON o.key = k.key)
SELECT new, updated, (SELECT count(*) FROM fresh) - new - updated AS skipped FROM n""")  # fmt: skip
def import_counters(spark, d):
    fresh = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("key"), F.col("o_orderstatus").alias("status"))
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("status"))
    return upsert.import_counts(known, fresh, "key", ["status"])


@query("retry_due", f"SELECT user_id, last_failure FROM ({FAILURES_SQL}) WHERE NOT terminal AND last_failure + to_seconds(backoff_s) <= TIMESTAMP '{CUT}' ORDER BY last_failure, user_id LIMIT 1000")
def retry_due(spark, d):
    due = ~F.col("terminal") & (F.unix_micros(F.col("last_failure").cast("timestamp")) + F.col("backoff_s") * 1_000_000 <= F.unix_micros(cut().cast("timestamp")))
    return listing.due_first(failures(spark, d), due, "last_failure", "user_id", 5000).select("user_id", "last_failure")


@query("backfill_queue", "SELECT o_orderkey FROM orders ORDER BY (o_orderpriority LIKE '1%') DESC, o_orderdate DESC, o_orderkey LIMIT 200")
def backfill_queue(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").startswith("1").alias("urgent"))
    return orders.orderBy(*listing.backfill_order("urgent", "o_orderdate", "o_orderkey")).limit(200).select("o_orderkey")


@query("shared_lookups", "SELECT p_partkey, md5(lower(trim(p_type))) AS place FROM part")
def shared_lookups(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    return links.looked_up_once(parts, F.lower(F.trim("p_type")), lambda keys: keys.withColumn("place", F.md5("key"))).select("p_partkey", "place")


@query("unappraised_lots", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END IS NULL")
def unappraised_lots(spark, d):
    rated = table(spark, d, "orders").withColumn("rating", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    return listing.unrated(rated, "rating").select("o_orderkey")


@query("either_price_match", """
SELECT a.p_partkey AS left_part, b.p_partkey AS right_part FROM part a JOIN part b ON a.p_brand <> b.p_brand AND a.p_size = b.p_size
AND (abs(a.p_retailprice - b.p_retailprice) <= greatest(1.0, least(abs(a.p_retailprice), abs(b.p_retailprice)) * 0.001)
  OR abs(a.p_retailprice - (b.p_retailprice + 100)) <= greatest(1.0, least(abs(a.p_retailprice), abs(b.p_retailprice + 100)) * 0.001))""")  # fmt: skip
def either_price_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("price"))
    l, r = (p.select(*[F.col(c).alias(f"{s}_{c}") for c in p.columns]) for s in "lr")
    found = resolve.either_band_join(l, r.withColumn("r_start", F.col("r_price") + 100), "l_price", ("r_price", "r_start"))
    other = (F.col("l_p_brand") != F.col("r_p_brand")) & (F.col("l_p_size") == F.col("r_p_size"))
    return found.where(other).select(F.col("l_p_partkey").alias("left_part"), F.col("r_p_partkey").alias("right_part"))


@query("listed_in_any_column", """
SELECT p_partkey FROM part WHERE contains(lower(p_partkey::VARCHAR), '1%') OR contains(lower(p_name), '1%') OR contains(lower(p_brand || '","' || p_type), 'd#1') """)
def listed_in_any_column(spark, d):
    p = table(spark, d, "part")
    plain = listing.search([F.col("p_partkey"), F.col("p_name")], "1%")
    return p.where(plain | listing.search([F.to_json(F.array("p_brand", "p_type"))], "D#1")).select("p_partkey")


@query("streaming_ingest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def streaming_ingest(spark, d):
    """The events read as a stream, the last of each user kept as a state of files; the state after the last batch."""
    home = f"{resolve.shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    columns = ["event_id", "event_type", "value"]
    schema = table(spark, d, "events").select("user_id", *columns).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    run = ingest.upsert_stream(stream, f"{home}/state", f"{home}/checkpoint", "user_id", "event_id", columns)
    run.awaitTermination()
    return state.BucketState(spark, f"{home}/state", schema, "user_id").read()


@query("scheduled_runs", """
SELECT c_custkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' - INTERVAL 30 MINUTES AND c_custkey % 5 <> 0 THEN 'skipped-already-running' ELSE 'queued' END AS action
FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY 1) ON c_custkey = o_custkey""")  # fmt: skip
def scheduled_runs(spark, d):
    last = history.latest(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    states = last.select(F.col("o_custkey").alias("c_custkey"), status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("started"), F.col("o_orderdate").cast("timestamp_ntz").alias("requested"))
    asked = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5 == 0).alias("force"))
    return links.scheduled(asked, states, "c_custkey", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).select("c_custkey", "action")
