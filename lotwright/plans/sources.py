"""Answers of sources made of the driver's tables, and the records and exports they become."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import components, export
from ..sources import connectors, frontier, paging, records
from .catalogue import query
from .registry import table


@query("listing_records", """
SELECT 'reg:' || p_partkey AS external_id, p_name AS title, 'вид: ' || p_type || '; 76:01:000001:' || p_partkey AS description, CASE WHEN p_size % 2 = 0 THEN 'land' ELSE 'transport' END AS category,
  'yaroslavskaya-oblast' AS region_slug, 'Ярославская область' AS region_name, '76:01:000001:' || p_partkey AS cadastral_number, p_size::DOUBLE AS area, p_retailprice::DOUBLE AS start_price,
  (CASE WHEN p_size % 3 = 0 THEN 7 ELSE p_retailprice END)::DOUBLE AS current_price, CASE WHEN p_size % 5 = 0 THEN 'scheduled' WHEN p_size % 5 = 1 THEN 'closed' ELSE 'active' END AS auction_status,
  'https://lots.example/lot/' || p_partkey AS lot_url, TIMESTAMP '2026-05-15 10:00:00' AS published_at
FROM part""")  # fmt: skip
def listing_records(spark, d):
    size = F.col("p_size")
    nested = F.struct(F.struct(F.col("p_retailprice").cast("string").alias("amount")).alias("initialPrice"), F.when(size % 3 == 0, F.lit(7)).alias("finalPrice"))
    answer = F.struct(
        F.col("p_partkey").alias("ID"),
        F.col("p_name").alias("lotName"),
        F.concat(F.lit("<p>вид: "), "p_type", F.lit(";  76:01:000001:"), F.col("p_partkey").cast("string"), F.lit("</p>")).alias("lotDescription"),
        F.when(size % 2 == 0, "2").otherwise("").alias("categoryCode"),
        F.struct(F.lit("Транспорт и техника").alias("name")).alias("category"),
        F.struct(F.lit("Ярославская область").alias("label")).alias("subject"),
        nested.alias("prices"),
        size.alias("totalArea"),
        F.when(size % 5 == 0, "BIDDING").when(size % 5 == 1, "FAILED").otherwise("PUBLISHED").alias("lotStatus"),
        F.concat(F.lit("/lot/"), F.col("p_partkey").cast("string")).alias("lotUrl"),
        F.lit("2026-05-15T10:00:00+03:00").alias("publishDate"),
    )
    made = records.of_listings(table(spark, d, "part").select(F.to_json(answer).alias("payload")), "payload", "reg", "lots.example", "https://lots.example")
    return made.select("external_id", "title", "description", "category", "region_slug", "region_name", "cadastral_number", "area", "start_price", "current_price", "auction_status", "lot_url", "published_at")


@query("register_messages", """
SELECT c_custkey::VARCHAR AS external_id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Сообщение r.example ' || c_custkey) AS title, c_name AS debtor_name, c_acctbal::DOUBLE AS start_price,
  CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey ELSE c_custkey::VARCHAR END AS efresb_message_number, 'https://r.example/card?id=' || c_custkey AS lot_url, false AS land_risk_flag
FROM customer WHERE c_custkey % 7 <> 0""")  # fmt: skip
def register_messages(spark, d):
    key = F.col("c_custkey")
    message = F.struct(
        F.when(key % 7 != 0, key).alias("GUID"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("Title"),
        F.col("c_name").alias("bankruptName"),
        F.col("c_acctbal").cast("double").alias("startPrice"),
        F.when(key % 2 == 0, F.concat(F.lit("n"), key.cast("string"))).alias("messageNumber"),
    )
    made = records.of_messages(table(spark, d, "customer").select(F.to_json(message).alias("payload")), "payload", "r", "r.example", "https://r.example/card?id=", "https://r.example/v1/")
    return made.select("external_id", "title", "debtor_name", "start_price", "efresb_message_number", "lot_url", "land_risk_flag")


def _product_page(key, name, price):
    text = key.cast("string")
    card = F.concat(F.lit("<div class='ty-grid-list__item x'><a class='product-title' href='index.php?dispatch=products.view&product_id="), text, F.lit("'>"), name, F.lit("</a><span class=ty-price-num>"), price, F.lit(" руб.</span><b class=ty-grid-list__product-code>РАД-"), text, F.lit("</b><img class=ty-pict src='/i/"), text, F.lit(".png'><img class=ty-pict src='data:x'></div>"))
    return F.concat(card, card, F.lit("<div class=ty-pagination><a href='?page=2'>2</a><a href='?q=1&page=17'>last</a></div>"))


@query("catalogue_products", """
SELECT 'cat:' || p_partkey AS external_id, p_name AS title, p_size::DOUBLE AS current_price, 'РАД-' || p_partkey AS procedure_number, 'https://c.example/index.php?dispatch=products.view&product_id=' || p_partkey AS lot_url,
  '["https://c.example/i/' || p_partkey || '.png"]' AS images
FROM part""")  # fmt: skip
def catalogue_products(spark, d):
    pages = table(spark, d, "part").select(_product_page(F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")).alias("html"))
    made = records.of_products(pages, "html", "cat", "c.example", "https://c.example", "active")
    return made.select("external_id", "title", "current_price", "procedure_number", "lot_url", F.get_json_object("raw_data", "$.image_urls").alias("images"))


@query("linked_lots", """
SELECT 'reg:' || p_partkey AS external_id, 'Земельный участок номер ' || p_partkey AS title, 'land' AS category, (100 * p_size)::DOUBLE AS current_price, 'active' AS auction_status, 'https://l.example/new/public/lots/lot/' || p_partkey || '/x' AS lot_url
FROM part""")  # fmt: skip
def linked_lots(spark, d):
    key = F.col("p_partkey").cast("string")
    link = F.concat(F.lit("<a href='/new/public/lots/lot/"), key, F.lit("/x'>"))
    page = F.concat(F.lit("<p>"), link, F.lit("Земельный участок номер "), key, F.lit("</a> Прием заявок. Начальная цена "), (F.col("p_size") * 100).cast("string"), F.lit(" руб.</p>"), link, F.lit("подробнее</a><a href='/other/lot/1'>Ссылка на что-то совсем другое</a>"))
    made = records.of_links(table(spark, d, "part").select(page.alias("html")), "html", "reg", "l.example", "https://l.example")
    return made.select("external_id", "title", "category", "current_price", "auction_status", "lot_url")


@query("registry_export", """
SELECT p_partkey AS "Код", p_name AS "Название", CASE WHEN p_size % 2 = 0 THEN 'Земельный участок' ELSE 'Прочее' END AS "Категория", trunc(p_retailprice)::BIGINT AS "Текущая цена", p_size / 10.0 AS "Площадь участка, сот.",
  CASE WHEN p_size % 3 = 0 THEN 'Активен' ELSE p_brand END AS "Статус торгов"
FROM part""")  # fmt: skip
def registry_export(spark, d):
    size = F.col("p_size")
    lots = table(spark, d, "part").select(
        F.col("p_partkey").alias("external_id"), F.col("p_name").alias("title"), F.when(size % 2 == 0, "land").otherwise("other").alias("category"), F.col("p_retailprice").alias("current_price"),
        (size * 10.0).alias("land_area"), F.when(size % 3 == 0, F.lit("active")).otherwise(F.col("p_brand")).alias("auction_status"),
    )
    wanted = ("Код", "Название", "Категория", "Текущая цена", "Площадь участка, сот.", "Статус торгов")
    return export.registry_table(lots).select(*[f"`{c}`" for c in wanted])


@query("crawl_ends", """
WITH r AS (SELECT event_type AS source, event_id // 1000 + 1 AS page, user_id AS ident FROM events), first AS (SELECT source, ident, min(page) AS page FROM r WHERE ident IS NOT NULL GROUP BY 1, 2),
p AS (SELECT source, page, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT p.*, (SELECT count(*) FROM first f WHERE f.source = p.source AND f.page <= p.page) AS ids FROM p),
w AS (SELECT *, CASE WHEN source = 'error' AND page = 3 THEN 'page_3_error' WHEN ids >= 140 THEN 'max_items=140' WHEN source = 'view' AND page >= 2 THEN 'reached_total_pages'
  WHEN source NOT IN ('view', 'error') AND page % 4 = 0 AND n < 5000 THEN 'has_more_false' WHEN page = 6 THEN 'max_pages' END AS why FROM c WHERE page <= 6),
e AS (SELECT source, coalesce(min(page) FILTER (why IS NOT NULL), max(page)) AS page FROM w GROUP BY 1)
SELECT w.source, w.page, coalesce(why, 'max_pages') AS reason, ids AS n_ids, (SELECT count(*) FROM w v WHERE v.source = w.source AND v.page <= w.page) AS n_pages FROM w JOIN e ON w.source = e.source AND w.page = e.page""")  # fmt: skip
def crawl_ends(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), (F.floor(F.col("event_id") / 1000) + 1).alias("page"), F.col("user_id").alias("ident"))
    source, page = F.col("source"), F.col("page")
    pages = rows.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n_items")).select(
        "*", F.when(source == "view", 2).when(source == "error", 99).alias("total_pages"), (page % 4 != 0).alias("has_more"), F.when((source == "error") & (page == 3), "timed out").alias("error")
    )
    return paging.crawl_ends(pages, rows, "source", "ident", 5000, 6, 140)


@query("listing_deadlines", """
SELECT 'reg:' || o_orderkey AS external_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 30 DAYS END AS application_deadline, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 40 DAYS END AS auction_at,
  'N-' || o_custkey AS notice_number, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate + INTERVAL 30 DAYS, '%d.%m.%Y %H:%M') ELSE '' END AS shown
FROM orders""")  # fmt: skip
def listing_deadlines(spark, d):
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    ends, starts = F.date_format(at + F.expr("INTERVAL 30 DAYS"), "dd.MM.yyyy HH:mm"), F.date_format(at + F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'+03:00'")
    answer = F.struct(key.alias("id"), F.concat(F.lit("Лот "), key.cast("string")).alias("lotName"), F.concat(F.lit("N-"), F.col("o_custkey").cast("string")).alias("noticeNumber"), F.when(key % 4 > 0, ends).alias("biddEndTime"), F.when(key % 3 > 0, starts).alias("auctionStartDate"))
    made = records.of_listings(table(spark, d, "orders").select(F.to_json(answer).alias("payload")), "payload", "reg", "lots.example", "https://lots.example")
    return made.select("external_id", "application_deadline", "auction_at", "notice_number", F.get_json_object("raw_data", "$.dates[1].text").alias("shown"))


PAGE = 50


def _saved(parts):
    """Answers of a source that holds the parts, a page of PAGE each, every seventh of which is cut off."""
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("lotStatus"), F.col("p_name").alias("name"))
    pages = parts.groupBy(F.floor(F.col("p_partkey") / PAGE).cast("int").alias("number")).agg(F.array_sort(F.collect_list(item)).alias("lots"))
    said = F.to_json(F.struct("number", F.lit(10_000_000).alias("totalElements"), F.struct("lots").alias("data")))
    return pages.select("number", F.when(F.col("number") % 7 == 6, F.left(said, F.lit(40))).otherwise(said).alias("value"))


@query("resumed_pages", f"""
SELECT p_partkey::VARCHAR AS ident, (p_partkey // {PAGE})::INTEGER AS page, (p_partkey % {PAGE})::INTEGER AS position, p_type AS status, NULL::VARCHAR AS error FROM part WHERE p_partkey // {PAGE} % 7 <> 6
UNION ALL SELECT NULL, NULL, NULL, NULL, 'no JSON' FROM (SELECT DISTINCT p_partkey // {PAGE} AS n FROM part) WHERE n % 7 = 6""")
def resumed_pages(spark, d):
    """Pages read as a stream that ends, and goes on from its checkpoint after more pages have been saved."""
    home = f"{components.shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    saved = _saved(table(spark, d, "part"))
    for half in (0, 1):
        saved.where(F.col("number") % 2 == half).select("value").write.mode("append").option("maxRecordsPerFile", 1).text(f"{home}/saved")
        rows = connectors.page_items(connectors.saved_pages(spark, f"{home}/saved", stream=True)).select("ident", "page", "position", "status", "error")
        rows.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{home}/out")


@query("source_pages_health", f"""
WITH p AS (SELECT *, p_partkey // {PAGE} AS n FROM part)
SELECT count(DISTINCT n) AS pages, count(DISTINCT n) FILTER (n % 7 = 6) AS failed, 0::BIGINT AS empty, 10000000::BIGINT AS total, count(*) FILTER (n % 7 <> 6) AS items, count(*) FILTER (n % 7 <> 6) AS ids, 10000000 - count(*) FILTER (n % 7 <> 6) AS missing,
  CASE WHEN count(*) FILTER (n % 7 = 6) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM p""")
def source_pages_health(spark, d):
    return connectors.health(_saved(table(spark, d, "part")).select(F.col("value").alias("payload"), F.lit("x").alias("file")))


_LINKED = """links AS (SELECT page_id, regexp_extract_all(html, 'href="/([^"/?#]+)"', 1) AS l FROM pages), p AS (SELECT page_id, l[1] AS address, CASE WHEN page_id % 9 = 4 THEN 'timeout' END AS cause, l[2:] AS l FROM links WHERE len(l) > 0)"""


@query("pages_reached", f"""
WITH RECURSIVE {_LINKED}, edges AS (SELECT DISTINCT address, unnest(l) AS link FROM p WHERE cause IS NULL),
r(address, depth) AS (SELECT address, 0 FROM p WHERE page_id % 25 = 0 UNION SELECT link, depth + 1 FROM r JOIN edges USING (address) WHERE depth < 25),
s AS (SELECT address, bool_and(cause IS NOT NULL) AS failed FROM p GROUP BY 1)
SELECT address, min(depth) AS depth, CASE WHEN failed IS NULL THEN 'unknown' WHEN failed THEN 'failed' ELSE 'read' END AS status, CASE WHEN failed THEN 'timeout' END AS cause FROM r LEFT JOIN s USING (address) GROUP BY address, failed""")
def pages_reached(spark, d):
    """A page's first link stands for its own address, the others lead on; every ninth page could not be read."""
    links = F.regexp_extract_all("html", F.lit('href="/([^"/?#]+)"'), 1)
    pages = table(spark, d, "pages").select("page_id", links.alias("l")).where(F.size("l") > 0)
    pages = pages.select("page_id", F.element_at("l", 1).alias("address"), F.slice("l", F.lit(2), F.size("l")).alias("links"), F.when(F.col("page_id") % 9 == 4, "timeout").alias("cause"))
    return frontier.reached(pages, pages.where("page_id % 25 = 0"))
