"""Listings, maps, statistics and quality counters over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import history, listing
from .catalogue import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lots: with customer and nation."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


LOTS_SQL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
SORTS = {"price_asc": F.col, "price_desc": F.col}


@query("registry_listing", f"""
SELECT o_orderkey, c_name, n_name, c_mktsegment, o_totalprice FROM {LOTS_SQL}
WHERE o_orderstatus IN ('O', 'P') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice BETWEEN 1000 AND 300000 AND lower(c_name) LIKE '%customer%'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")  # fmt: skip
def registry_listing(spark, d):
    found = listing.facets(lots(spark, d), {"o_orderstatus": ["O", "P"], "c_mktsegment": ["BUILDING", "MACHINERY"]}, {"o_totalprice": (1000, 300000)}, ["c_name"], "Customer")
    modes = {"price_desc": F.col("o_totalprice").desc(), "newest": F.col("o_orderdate").desc()}
    return listing.page(listing.ordered(found, modes, "price_desc", "newest", "o_orderkey"), 2, 20).select("o_orderkey", "c_name", "n_name", "c_mktsegment", "o_totalprice")


@query("multi_column_search", """
SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%'""")
def multi_column_search(spark, d):
    return table(spark, d, "part").where(listing.search([F.col(c) for c in ("p_name", "p_brand", "p_type")], "1")).select("p_partkey", "p_name", "p_brand")


@query("all_terms_search", r"""
SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AND contains(lower(text), 'of')""")
def all_terms_search(spark, d):
    return table(spark, d, "documents").where(text.contains_all_terms("text", "the of")).select("doc_id")


@query("region_stats", """
SELECT r_name, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_lots, count(avg_discount) AS rated, round(avg(avg_discount), 4)::DOUBLE AS avg_discount
FROM (SELECT r_name, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) o
LEFT JOIN (SELECT l_orderkey, sum(l_discount::DECIMAL(12,2))::DOUBLE / count(*) AS avg_discount FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey
GROUP BY r_name""")
def region_stats(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))).alias("avg_discount"))
    o = lots(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "o_orderkey", "o_orderstatus")
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open_lots"), F.count("avg_discount").alias("rated"), F.round(F.avg("avg_discount"), 4).alias("avg_discount"))


@query("quality_snapshot", """
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders_with_lines, (SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) = '') AS blank_texts,
 (SELECT count(*) FROM documents WHERE source IS NULL) AS no_source, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events WHERE props IS NULL) AS no_props, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def quality_snapshot(spark, d):
    one = lambda t, **aggs: table(spark, d, t).agg(*[c.alias(n) for n, c in aggs.items()])
    parts = [
        one("orders", n_orders=F.count(F.lit(1))),
        one("lineitem", orders_with_lines=F.count_distinct("l_orderkey")),
        one("documents", blank_texts=F.count_if(F.trim(F.coalesce("text", F.lit(""))) == ""), no_source=F.count_if(F.col("source").isNull())),
        one("events", users=F.count_distinct("user_id"), no_props=F.count_if(F.col("props").isNull()), errors=F.count_if(F.col("event_type") == "error")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out


@query("source_health", """
SELECT coalesce(c.event_type, s.event_type) AS source, coalesce(n, 0) AS items, coalesce(status, 'unknown') AS status
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c FULL JOIN (VALUES ('view', 'ok'), ('error', 'failed'), ('refund', 'ok')) s(event_type, status) ON c.event_type = s.event_type""")
def source_health(spark, d):
    known = spark.createDataFrame([("view", "ok"), ("error", "failed"), ("refund", "ok")], "source string, status string")
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("items"))
    return counts.join(known, "source", "full").select("source", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("status", F.lit("unknown")).alias("status"))


@query("latest_snapshot", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_snapshot(spark, d):
    return history.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("latest_snapshot_two_key", "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot_two_key(spark, d):
    return history.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], F.col("ts"), F.col("event_id"))


@query("first_occurrence", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_occurrence(spark, d):
    return history.first_occurrence(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


PLACES_SQL = "(SELECT c_custkey, c_name, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 18000) / 100.0 - 90 AS lat FROM customer)"


def places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", ((k * 7919 % 36000) / 100 - 180).alias("lon"), ((k * 104729 % 18000) / 100 - 90).alias("lat"))


@query("map_viewport", f"""
WITH hit AS (SELECT c_custkey FROM {PLACES_SQL} WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -45 AND 45)
SELECT c_custkey, (SELECT count(*) FROM hit) > 100 AS truncated FROM hit ORDER BY c_custkey LIMIT 100""")
def map_viewport(spark, d):
    return listing.truncated(places(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), -20, -45, 60, 45)).select("c_custkey"), 100, F.col("c_custkey"))


@query("map_viewport_antimeridian", f"SELECT c_custkey FROM {PLACES_SQL} WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -60 AND 60")
def map_viewport_antimeridian(spark, d):
    return places(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), 150, -60, -150, 60)).select("c_custkey")


@query("map_statistics", """
SELECT count(*) AS total, count(n) AS mapped, greatest(count(*) - count(n), 0) AS without_place, max(last) AS last_update
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def map_statistics(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("n").alias("mapped"), F.greatest(F.count(F.lit(1)) - F.count("n"), F.lit(0)).alias("without_place"), F.max("last").alias("last_update"))


@query("haversine_topk", f"""
SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km FROM (
 SELECT c_custkey, pow(sin(radians(lat - 55.75) / 2), 2) + cos(radians(55.75)) * cos(radians(lat)) * pow(sin(radians(lon - 37.62) / 2), 2) AS a FROM {PLACES_SQL})
ORDER BY 2, 1 LIMIT 25""")
def haversine_topk(spark, d):
    km = F.round(geo.haversine_km(F.lit(55.75), F.lit(37.62), F.col("lat"), F.col("lon")), 3)
    return places(spark, d).select("c_custkey", km.alias("km")).orderBy("km", "c_custkey").limit(25)


@query("mercator_convert", """
SELECT c_custkey, round(degrees(c_custkey * 1000.0 / 6378137), 6)::DOUBLE AS lon, round(degrees(atan((exp(y) - exp(-y)) / 2)), 6)::DOUBLE AS lat
FROM (SELECT c_custkey, c_custkey * 700.0 / 6378137 AS y FROM customer WHERE c_custkey > 1)""")
def mercator_convert(spark, d):
    k = F.col("c_custkey")
    p = geo.mercator_to_degrees(k * 1000.0, k * 700.0)
    return table(spark, d, "customer").where(k > 1).select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("same_point_groups", f"SELECT round(lat, -1)::DOUBLE + 0.0 AS lat, round(lon, -1)::DOUBLE + 0.0 AS lon, count(*) AS lots FROM {PLACES_SQL} GROUP BY 1, 2 HAVING count(*) > 1")
def same_point_groups(spark, d):
    return places(spark, d).groupBy((F.round("lat", -1) + 0.0).alias("lat"), (F.round("lon", -1) + 0.0).alias("lon")).agg(F.count(F.lit(1)).alias("lots")).where("lots > 1")


@query("percentile_latency", """
SELECT event_type, max(value) FILTER (WHERE rn = ceil(0.5 * n)) AS p50, max(value) FILTER (WHERE rn = ceil(0.95 * n)) AS p95, max(value) AS worst
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def percentile_latency(spark, d):
    # Nearest rank from counts of values: a partial aggregate, whatever the number of rows of a type.
    counts = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").where("value IS NOT NULL").groupBy("event_type").agg(counts[0].alias("p50"), counts[1].alias("p95"), F.max("value").alias("worst"))


@query("run_rollup", """
SELECT ts::DATE AS day, CASE WHEN bool_and(event_type <> 'error') THEN 'success' WHEN bool_and(event_type = 'error') THEN 'failed' ELSE 'partial' END AS status, count(*) AS sources FROM events GROUP BY 1""")
def run_rollup(spark, d):
    failed = F.col("event_type") == "error"
    status = F.when(F.every(~failed), "success").when(F.every(failed), "failed").otherwise("partial")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(status.alias("status"), F.count(F.lit(1)).alias("sources"))


#: Each table and what names a row of it: a copy by keys has as many rows as there are keys.
TABLE_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id"],
}


@query("row_count_reconcile", " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS source_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {t})) AS target_rows, (SELECT count(*) FROM {t}) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {t})) AS matches" for t, k in TABLE_KEYS.items()))
def row_count_reconcile(spark, d):
    """Rows of each table against those of its copy by keys; conversations have several rows a key, so theirs differ."""
    counted = []
    for t, keys in TABLE_KEYS.items():
        groups = table(spark, d, t).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        counted.append(groups.agg(F.lit(t).alias("table_name"), F.coalesce(F.sum("_n"), F.lit(0)).alias("source_rows"), F.count(F.lit(1)).alias("target_rows")))
    return reduce(DataFrame.unionByName, counted).select("table_name", "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("matches"))


@query("admin_dashboard", """
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS closed_lots, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures, (SELECT max(ts) FROM events) AS last_event""")
def admin_dashboard(spark, d):
    a = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed_lots"))
    c = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last_event"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # single rows


@query("top_rated", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_rated(spark, d):
    return table(spark, d, "part").where("p_retailprice IS NOT NULL").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("region_labels", "SELECT DISTINCT r_name || ' / ' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_labels(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat_ws(" / ", "r_name", "n_name").alias("label")).distinct()


@query("global_merge_page", """
SELECT o_orderkey, o_orderpriority, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
WHERE rn <= 60 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def global_merge_page(spark, d):
    from ..sources.paging import merged_page

    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return merged_page(o, "o_orderpriority", "o_orderkey", "o_orderdate", number=3, size=20)


@query("lot_card", """
SELECT o_orderkey, CASE WHEN length(p.names) > 60 THEN substr(p.names, 1, 60) || '...' ELSE p.names END AS title, nullif(o_totalprice, 0) AS price, n_lines
FROM orders JOIN (SELECT l_orderkey, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS names, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) p ON o_orderkey = l_orderkey""")
def lot_card(spark, d):
    names = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("names"), F.count(F.lit(1)).alias("n_lines"))
    j = table(spark, d, "orders").join(names, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", text.shorten("names", 60).alias("title"), F.nullif("o_totalprice", F.lit(0.0)).alias("price"), "n_lines")
