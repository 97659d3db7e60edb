"""Classifiers, extraction and scoring over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, jsonwalk, money, regions, text
from ..sources import cards
from .catalogue import query
from .registry import table

# Words of the driver's parts, in place of the listings' language: the first rule that holds decides.
PART_RULES = (("metal", ("steel", "brass", "copper", "tin", "nickel")), ("polished", ("polished",)), ("small", ("small", "economy")))


@query("category_classifier", "SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(p_name || ' ' || p_type), '{w}')''' for w in words)} THEN '{n}'" for n, words in PART_RULES) + " ELSE 'other' END AS category FROM part")
def category_classifier(spark, d):
    from ..functions.classify import first_rule

    return table(spark, d, "part").select("p_partkey", first_rule(F.lower(F.concat_ws(" ", "p_name", "p_type")), PART_RULES, F.lit("other")).alias("category"))


@query("status_normalizer", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'active' WHEN event_type = 'purchase' THEN 'closed' WHEN event_type = 'signup' THEN 'scheduled' ELSE event_type END AS status FROM events""")
def status_normalizer(spark, d):
    from ..functions import classify

    said = {"view": "Опубликовано", "purchase": "Торги завершены", "signup": "Ожидает публикации"}
    return table(spark, d, "events").select("event_id", classify.status(classify.label("event_type", said)).alias("status"))


@query("region_lookup", """
SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE lpad(c_nationkey::VARCHAR, 2, '0') END AS region_code FROM customer""")
def region_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("said"))
    return regions.with_region(c, "said").select("c_custkey", "region_code")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("identifier_extract", f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS identifier FROM documents")
def identifier_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), 0))).alias("identifier"))


@query("labelled_amount")
def labelled_amount(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Лот "), "p_name", F.lit(". Начальная цена: "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" руб., задаток 100 руб.")).alias("said"))
    return p.select("p_partkey", extract.price("said").alias("x")).select("p_partkey", F.col("x.value").alias("price"), F.col("x.rule_id").alias("rule_id"), F.col("x.confidence").alias("confidence"))


@query("html_cards")
def html_cards(spark, d):
    return cards.extract(table(spark, d, "pages").select("page_id", "html"), "page_id", "html")


@query("html_titles", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def html_titles(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit("<a "), 0)).cast("long").alias("links"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/(\d+)', 1) AS ident FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/?#:]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), F.regexp_extract(u, r"/(\d+)", 1).alias("ident"))


@query("canonical_key", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'cadastral:' || c_custkey WHEN c_custkey % 5 = 0 THEN 'efrsb:' || c_custkey WHEN c_custkey % 3 = 0 THEN 'case:' || c_nationkey || ':' || c_custkey ELSE 'source:' || c_mktsegment || ':' || c_custkey END AS key FROM customer""")
def canonical_key(spark, d):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    when = lambda n, v: F.when(k % n == 0, v).otherwise("  ")
    key = extract.canonical_key(when(7, F.concat(F.lit(" "), s)), when(5, s), when(3, F.col("c_nationkey").cast("string")), when(3, s), F.col("c_mktsegment"), s)
    return table(spark, d, "customer").select("c_custkey", key.alias("key"))


@query("json_first_nonempty", "SELECT event_id, coalesce(nullif(props->>'$.missing', ''), nullif(props->>'$.k', '')) AS k FROM events")
def json_first_nonempty(spark, d):
    return table(spark, d, "events").select("event_id", jsonwalk.first_non_empty("props", "missing", "k").alias("k"))


_RATED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, (l_discount * 100)::INTEGER AS discount, (l_quantity % 10)::INTEGER AS risk, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'closed' END AS status,
 CASE l_returnflag WHEN 'R' THEN 'low' WHEN 'A' THEN 'medium' ELSE 'high' END AS confidence FROM lineitem"""


@query("discount_rating", f"""
SELECT risk, status, confidence, discount, count(*) AS n, max(CASE WHEN status <> 'active' THEN 0 ELSE round(greatest(0, least(100, discount * 0.35 + (10 - risk) * 3.0 + 20 - CASE confidence WHEN 'low' THEN 10 WHEN 'medium' THEN 4 ELSE 0 END - 8)), 2) END)::DOUBLE AS rating
FROM ({_RATED}) GROUP BY 1, 2, 3, 4""")
def discount_rating(spark, d):
    l, none = table(spark, d, "lineitem"), F.lit(None).cast("string")
    flag = F.col("l_returnflag")
    r = l.select((F.round(F.col("l_discount") * 100)).cast("int").alias("discount"), (F.col("l_quantity") % 10).cast("int").alias("risk"), F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"), F.when(flag == "R", "low").when(flag == "A", "medium").otherwise("high").alias("confidence"))
    rated = r.groupBy("risk", "status", "confidence", "discount").agg(F.count(F.lit(1)).alias("n"))
    return rated.withColumn("rating", money.rating(F.col("discount"), F.col("risk"), F.col("status"), F.col("confidence"), F.lit("apartment"), none, none, F.lit(50.0)).cast("double"))


@query("bid_scenarios", """
WITH s(scenario, fs, fc, fm) AS (VALUES ('pessimistic', 0.90::DOUBLE, 1.15::DOUBLE, 1.25::DOUBLE), ('base', 1.0, 1.0, 1.0), ('optimistic', 1.05, 0.95, 0.8)),
x AS (SELECT p_partkey, scenario, p_retailprice * fs AS price, 6 * fm AS months, (100 + 50 + 20 + 30) * fc + 5 * 6 * fm + p_retailprice * fs * 2.0 / 100 AS costs, 1 + 12.0 / 100 * (6 * fm) / 12 AS factor FROM part, s)
SELECT p_partkey, scenario, round(greatest(0, (price - costs - 100) / factor), 2)::DOUBLE AS maximum_bid, round(months, 2)::DOUBLE AS holding_months FROM x""")
def bid_scenarios(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    v = {k: F.lit(float(x)) for k, x in dict(repair=100, legal=50, holding=5, months=6, taxes=20, commission=2, target=100, reserve=30, capital=12).items()}
    rows = money.bid_scenarios(p, sale=F.col("p_retailprice"), bid=F.lit(None), **v)
    return rows.select("p_partkey", "scenario", "maximum_bid", "holding_months")


@query("slugs", "SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha256(n_name), 1, 20) AS ident FROM nation")
def slugs(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.slug("n_name").alias("slug"), text.hash_id(F.col("n_name")).alias("ident"))
