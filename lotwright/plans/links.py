"""Source cards, canonical assets, procedures, runs and places over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, geo, money
from ..operators import dossier, links
from .catalogue import query
from .registry import table

_CARDS = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS kind, props FROM events"


@query("source_cards", f"SELECT event_id, CASE WHEN kind <> '' THEN kind ELSE nullif(props->>'$.k', '') END AS kind, event_type IN ('closed', 'archived') AS archived FROM ({_CARDS})")
def source_cards(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return e.select("event_id", *links.card_columns("props", {"kind": ("missing", "k")}, "event_type"))


_KEYS = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cadastral:' || o_custkey WHEN o_orderkey % 3 = 0 THEN 'efrsb:' || o_custkey ELSE NULL END AS key FROM orders"


@query("canonical_assignment", f"SELECT o_orderkey, CASE WHEN key IS NULL THEN o_orderkey ELSE min(o_orderkey) OVER (PARTITION BY key) END AS canonical_id FROM ({_KEYS})")
def canonical_assignment(spark, d):
    k, none = F.col("o_custkey").cast("string"), F.lit(None).cast("string")
    key = extract.canonical_key(F.when(F.col("o_orderkey") % 4 == 0, k), F.when(F.col("o_orderkey") % 3 == 0, k), none, none, none, none)
    return links.canonical_ids(table(spark, d, "orders").select("o_orderkey", key.alias("key")), "key", "o_orderkey").select("o_orderkey", "canonical_id")


@query("missing_links", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def missing_links(spark, d):
    l = table(spark, d, "lineitem")
    return links.missing_links(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])


_SIDES = """x AS (SELECT p_partkey AS id, p_brand AS source, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS identifier, p_retailprice::DOUBLE AS price FROM part),
f AS (SELECT * FROM x WHERE id % 10 = 0), k AS (SELECT * FROM x WHERE id % 10 <> 0 AND id % 3 = 0)"""


@query("incremental_match", f"""
WITH {_SIDES}, m AS (
 SELECT f.id, k.id AS match, 0 AS rank FROM f JOIN k ON f.identifier = k.identifier AND f.source <> k.source AND abs(f.price - k.price) / greatest(f.price, k.price, 1) <= 0.05
 UNION ALL SELECT f.id, k.id, 1 FROM f JOIN k ON f.source <> k.source AND abs(f.price - k.price) <= greatest(1.0, least(f.price, k.price) * 0.001))
SELECT f.id, (SELECT match FROM m WHERE m.id = f.id ORDER BY rank, match LIMIT 1) AS match FROM f""")
def incremental_match(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("identifier"), F.col("p_retailprice").cast("double").alias("price"))
    return links.first_match(x.where("id % 10 = 0"), x.where("id % 10 <> 0 AND id % 3 = 0"))


@query("place_resolution", """
SELECT c_custkey, coalesce(s.s_suppkey::DOUBLE, n.n_nationkey::DOUBLE) AS lat, CASE WHEN s.s_suppkey IS NOT NULL THEN 'cadastral' WHEN n.n_nationkey IS NOT NULL THEN 'address' ELSE 'unresolved' END AS geo_method
FROM customer LEFT JOIN supplier s ON c_custkey = s_suppkey LEFT JOIN nation n ON c_nationkey = n_nationkey AND n_nationkey < 20""")
def place_resolution(spark, d):
    lots = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("number"), F.col("c_nationkey").alias("address"))
    numbers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_suppkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    addresses = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("address"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return links.places(lots, numbers, addresses).select("c_custkey", "lat", "geo_method")


@query("address_backfill", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN length(p_name || ' ' || p_type) < 15 AND p_partkey % 5 > 0 THEN p_type ELSE p_name || ' ' || p_type END AS address FROM part")
def address_backfill(spark, d):
    own, found = F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(" ", "p_name", "p_type")), F.when((F.col("p_partkey") % 5 > 0) | (F.col("p_partkey") % 3 == 0), F.col("p_type")).otherwise("")
    return table(spark, d, "part").select("p_partkey", links.filled_address(own, found).alias("address"))


@query("cached_valuation", "SELECT c_custkey, (SELECT max_by(o_totalprice, (o_orderdate, o_totalprice)) FROM orders WHERE o_custkey = c_custkey)::DOUBLE AS value FROM customer")
def cached_valuation(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.col("o_totalprice").cast("double").alias("value"))
    return links.cached_valuation(table(spark, d, "customer").select("c_custkey"), runs, "c_custkey", "o_orderdate", "value")


@query("primary_ids", "SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS id FROM orders")
def primary_ids(spark, d):
    return links.primaries(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("primary")), "id", "primary")


@query("newest_kept", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def newest_kept(spark, d):
    return links.newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("circuit_state", "SELECT event_type, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) >= 300 AS available FROM events GROUP BY 1")
def circuit_state(spark, d):
    return links.open_circuits(table(spark, d, "events"), "event_type", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_type", "available")


@query("run_lease", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def run_lease(spark, d):
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.when(F.col("o_orderkey") % 7 == 0, as_of - F.expr("INTERVAL 9 MINUTES")).otherwise(as_of - F.expr("INTERVAL 10 MINUTES")).alias("beat"))
    return links.lease_holder(runs, "o_orderdate", "beat", as_of).select("id")


@query("response_etag", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS etag FROM nation""")
def response_etag(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(12).alias("server_ms"))
    return n.select("n_nationkey", links.etag(n, "server_ms").alias("etag"))


@query("procedure_lookup", "SELECT s_suppkey, min(l_orderkey) AS first_order FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus ILIKE 'o' GROUP BY 1")
def procedure_lookup(spark, d):
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.lit("o").alias("source"))
    cards = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("number"), F.col("l_linestatus").alias("source"), F.col("l_orderkey").alias("first_order"))
    return dossier.first_by_procedure(asked, cards, "number", "source", "first_order").select(F.col("number").alias("s_suppkey"), "first_order")


@query("lot_documents", """
SELECT c_custkey, count(DISTINCT o_orderkey) AS cards, count(l_linenumber) AS documents, coalesce(sum(l_quantity), 0)::DOUBLE AS pages
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def lot_documents(spark, d):
    cards = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    documents = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    whole = dossier.dossiers(table(spark, d, "customer").select("c_custkey"), cards, documents, "c_custkey", "o_orderkey", ["l_linenumber"])
    each = F.flatten(F.transform("cards", lambda x: x["documents"]))
    pages = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x["l_quantity"])
    return whole.select("c_custkey", F.size("cards").cast("long").alias("cards"), F.size(each).cast("long").alias("documents"), pages.alias("pages"))


@query("canonical_consistency", """
SELECT l_orderkey, l_linenumber, l_partkey, reason FROM (SELECT *, CASE WHEN o_orderkey IS NULL OR l_orderkey % 17 = 0 THEN 'no lot' WHEN l_suppkey % 19 = 0 THEN 'no asset' WHEN o_custkey % 5 = 0 AND o_custkey % 100 <> l_suppkey THEN 'another asset' END AS reason
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) WHERE reason IS NOT NULL""")
def canonical_consistency(spark, d):
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lots = table(spark, d, "orders").where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 100).alias("_asset"))
    assets = table(spark, d, "supplier").where("s_suppkey % 19 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return dossier.contradictions(links, lots, assets, "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query("runs_with_sources", "SELECT o_orderkey, o_orderstatus, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS sources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def runs_with_sources(spark, d):
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    runs = dossier.with_sources(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), parts, "o_orderkey", "l_linenumber")
    numbers = F.array_join(F.transform("parts", lambda x: x["l_linenumber"].cast("string")), ",")
    return runs.select("o_orderkey", "o_orderstatus", F.nullif(numbers, F.lit("")).alias("sources"))


@query("source_cache_filter", """
SELECT p_partkey FROM part WHERE p_partkey % 6 <> 0 AND contains(lower(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END), '1') AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))
AND coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, p_retailprice + 50) BETWEEN 950 AND 1500
UNION ALL SELECT p_partkey + 1000000 FROM part WHERE p_partkey % 6 <> 0 AND contains(lower(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END), 'm')""")
def source_cache_filter(spark, d):
    key = F.col("p_partkey")
    cards = table(spark, d, "part").select(
        "p_partkey", (key % 6 == 0).alias("is_archived"), F.when(key % 2 == 0, F.col("p_brand")).alias("region_name"), F.to_json(F.struct(F.col("p_type").alias("region_name"))).alias("raw_data"), F.col("p_name").alias("title"),
        F.when(key % 4 > 0, F.col("p_type")).alias("address"), F.when(key % 3 == 0, F.col("p_retailprice")).alias("current_price"), (F.col("p_retailprice") + 50).alias("start_price"),
    )
    found = dossier.cached(cards, "raw_data", "1", "RING", 950, 1500).select("p_partkey")
    return found.union(dossier.cached(cards, "raw_data", "M").select(key + 1000000))


@query("desktop_map_filter", """
SELECT p_partkey FROM (SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_retailprice END, 0), p_size * 100, 0) AS price FROM part) WHERE price <> 0 AND price >= 950 AND price <= 1500""")
def desktop_map_filter(spark, d):
    p = table(spark, d, "part").withColumn("current", F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise(F.col("p_retailprice")))
    return p.where(money.within(F.coalesce(F.nullif("current", F.lit(0.0)), F.col("p_size") * 100), 950, 1500)).select("p_partkey")


@query("desktop_registry", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%' AND p_size IN (1, 2, 3, 4, 5, 6, 7) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def desktop_registry(spark, d):
    groups = {"small": tuple(range(1, 8)), "large": tuple(range(8, 51))}
    p = table(spark, d, "part").where(F.col("p_name").ilike("%BOLT%") & F.col("p_size").isin(*groups["small"]))
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("desktop_dashboard", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderkey % 4 <> 0) AS with_rating, (SELECT max(ts) FROM events WHERE event_type = 'purchase') AS last_sync FROM orders")
def desktop_dashboard(spark, d):
    lots = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("auction_status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("rating"))
    return dossier.overview(lots, table(spark, d, "events").where("event_type = 'purchase'").select(F.col("ts").alias("last_success_at")))


@query("page_maximum", r"SELECT page_id, CASE WHEN page_id % 3 > 0 THEN greatest(page_id % 40, 2) ELSE coalesce(list_max(list_transform(regexp_extract_all(html, 'href=\"/(\d+)', 1), lambda x: x::BIGINT)), 0) END AS last_page FROM pages")
def page_maximum(spark, d):
    numbers = F.transform(F.regexp_extract_all("html", F.lit(r'href="/(\d+)'), 1), lambda x: x.cast("long"))
    paginator = F.concat(F.lit('<a href="/2">2</a><a href="/'), (F.col("page_id") % 40).cast("string"), F.lit('/">last</a>'))  # the pages' own links have no numbers
    shown = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.concat("html", paginator)).otherwise(F.col("html")).alias("html"))
    return shown.select("page_id", F.coalesce(F.array_max(numbers), F.lit(0)).cast("long").alias("last_page"))


@query("prompt_projection", """SELECT p_partkey, substr('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}', 1, 60) AS prompt FROM part""")
def prompt_projection(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("json"))
    return p.select("p_partkey", F.substring("json", 1, 60).alias("prompt"))


@query("run_counters", """
SELECT o_custkey AS source, count(*) AS seen, count(*) FILTER (o_orderstatus = 'F') AS failed, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'success' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'failed' ELSE 'partial' END AS state FROM orders GROUP BY 1""")
def run_counters(spark, d):
    return dossier.source_counters(table(spark, d, "orders").select(F.col("o_custkey").alias("source"), "o_orderstatus"), "source", F.col("o_orderstatus") == "F")


@query("same_point_counts", """
SELECT round(lat, 9)::DOUBLE AS lat, round(lon, 9)::DOUBLE AS lon, count(*) AS n FROM (SELECT p_size + (p_partkey % 3) * 1e-11 AS lat, p_size * 2 - (p_partkey % 2) * 1e-11 AS lon FROM part) GROUP BY 1, 2 HAVING count(*) > 1""")
def same_point_counts(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") + (F.col("p_partkey") % 3) * F.lit(1e-11)).alias("lat"), (F.col("p_size") * 2 - (F.col("p_partkey") % 2) * F.lit(1e-11)).alias("lon"))
    return p.groupBy(geo.same_point(F.col("lat"), F.col("lon")).alias("at")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at.lat", "at.lon", "n")


@query("unsold_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unsold_parts(spark, d):
    sold = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(sold, "p_partkey", "left_anti")
