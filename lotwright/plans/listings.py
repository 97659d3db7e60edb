"""Listings' texts, dates, JSON and HTML made of the tables' columns, and what the operators read from them.

Every row's text differs by its numbers, names and dates. The SQL works each result out from the same columns, not from
the text, so it does not know the operators' rules. Odd texts stand in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, extract, geo, jsonwalk, money, text
from ..operators import listing
from .catalogue import query
from .registry import table
from .state import CUT, cut

c = F.col


def _words(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cents(v):
    return F.col(v).cast("decimal(14,2)")


@query("extracted_prices", """
SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderkey % 5 = 1 THEN 2 ELSE 1 END, 2)::DOUBLE AS price,
  ['price.start_price', 'price.current_price', 'price.sale_price', 'price.generic_price', 'price.single_currency_amount'][o_orderkey % 5 + 1] AS rule_id, ['high', 'high', 'medium', 'medium', 'low'][o_orderkey % 5 + 1] AS confidence
FROM orders WHERE o_orderkey % 7 > 0
UNION ALL SELECT o_orderkey, NULL, 'price.ambiguous_currency_amounts', 'none' FROM orders WHERE o_orderkey % 7 = 0""")
def extracted_prices(spark, d):
    price, kind = _cents("o_totalprice"), c("o_orderkey") % 5
    said = (
        F.when(kind == 0, _words("Лот ", c("o_orderkey"), ". Стартовая цена лота ", price, " руб"))
        .when(kind == 1, _words("Начальная цена ", price, " ₽, текущая цена ", (price * 2).cast("decimal(14,2)"), " ₽"))
        .when(kind == 2, _words("Цена продажи ", F.replace(price.cast("string"), F.lit("."), F.lit(",")), " рублей"))
        .when(kind == 3, _words("Стоимость: ", price, " руб"))
        .otherwise(_words("Продаётся за ", price, " руб."))
    )
    said = F.when(c("o_orderkey") % 7 == 0, _words(price, " руб. или ", (price + 100).cast("decimal(14,2)"), " руб.")).otherwise(said)
    return table(spark, d, "orders").select("o_orderkey", extract.price(said).alias("x")).select("o_orderkey", c("x.value").cast("double").alias("price"), "x.rule_id", "x.confidence")


@query("extracted_areas", """
SELECT p_partkey, p_size + 0.5 + p_partkey % 900 AS area, ['area.building_labeled', 'area.room_labeled', 'area.single_unlabeled'][p_partkey % 3 + 1] AS rule_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 + p_partkey % 900 END AS building, CASE WHEN p_partkey % 3 = 1 THEN p_size + 0.5 + p_partkey % 900 END AS room FROM part""")
def extracted_areas(spark, d):
    kind, n = c("p_partkey") % 3, _words(c("p_size") + c("p_partkey") % 900, ",5")
    said = F.when(kind == 0, _words("Нежилое здание общей площадью ", n, " кв.м")).when(kind == 1, _words("Помещение площадью ", n, " м2")).otherwise(_words("Объект ", n, " кв. м"))
    p = table(spark, d, "part").select("p_partkey", said.alias("said"))
    return p.select("p_partkey", extract.area("said").alias("x"), extract.building_area("said").alias("building"), extract.room_area("said").alias("room")).select("p_partkey", c("x.value").cast("double").alias("area"), "x.rule_id", "building", "room")


@query("extracted_land", "SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size * 10000 + 5000 ELSE p_size * 11 END)::DOUBLE AS land FROM part")
def extracted_land(spark, d):
    kind, n = c("p_partkey") % 3, c("p_size")
    said = F.when(kind == 0, _words("Земельный участок площадью ", n, " соток")).when(kind == 1, _words("земельного участка общей площадью ", n, ",5 га")).otherwise(_words("Земельный участок: ", n * 11, " кв.м"))
    return table(spark, d, "part").select("p_partkey", extract.land_area(said).cast("double").alias("land"))


@query("extracted_numbers", """
SELECT c_custkey, '76:23:010101:' || c_custkey || CASE WHEN c_custkey <> c_nationkey + 1 OR true THEN '|77:01:0001001:' || (c_nationkey + 1) END AS found,
  CASE WHEN c_custkey % 2 = 0 THEN '76:23:010101:' || c_custkey ELSE '' END AS valid FROM customer""")
def extracted_numbers(spark, d):
    k = c("c_custkey")
    said = _words("Участки 76:23:010101:", k, " и 76:23:010101:", k, ", 77:01:0001001:", c("c_nationkey") + 1)
    more = F.when(k % 2 == 0, _words(" 76:23: 010101:", k, " ")).otherwise(_words("bad ", k))
    cust = table(spark, d, "customer").select("c_custkey", said.alias("said"), more.alias("more"))
    return cust.select("c_custkey", F.array_join(extract.cadastral_numbers("said"), "|").alias("found"), F.array_join(extract.cadastral_set(c("more"), F.lit(None).cast("array<string>")), "|").alias("valid"))


@query("extracted_addresses", """
SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN 'г. Ярославль, ул. ' || c_mktsegment || ', д. ' || c_custkey END AS address FROM customer""")
def extracted_addresses(spark, d):
    place = _words("г. Ярославль, ул. ", c("c_mktsegment"), ", д. ", c("c_custkey"))
    said = F.when(c("c_custkey") % 6 == 0, "Адрес: коротко").when(c("c_custkey") % 2 == 0, _words("Адрес: ", place, " Кадастровый номер 76:23")).otherwise(_words("расположено по адресу: ", place))
    return table(spark, d, "customer").select("c_custkey", extract.address(said).alias("address"))


@query("extracted_facts", """
SELECT p_partkey, p_size % 30 + 1 AS floors, 1900 + p_size AS built, CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size END AS commissioned, p_partkey % 3 = 0 AS heritage,
  CASE p_partkey % 4 WHEN 0 THEN 'банкротные торги' WHEN 1 THEN 'продажа гос. имущества' END AS legal FROM part""")
def extracted_facts(spark, d):
    k, n = c("p_partkey"), c("p_size")
    said = _words(n % 30 + 1, " этажей, год постройки: ", n + 1900, F.when(k % 2 == 0, _words(", год ввода: ", n + 1950)).otherwise(""), F.when(k % 3 == 0, ". Объект культурного наследия").otherwise(""), F.when(k % 4 == 0, ". Банкротство").when(k % 4 == 1, ". госимущество").otherwise(""))
    p = table(spark, d, "part").select("p_partkey", said.alias("said"))
    return p.select("p_partkey", extract.floors("said").alias("floors"), extract.year_built("said", F.lit(2026)).alias("built"), extract.year_commissioned("said", F.lit(2026)).alias("commissioned"), extract.is_heritage("said").alias("heritage"), extract.legal_status("said").alias("legal"))


@query("parsed_money", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 > 0 THEN round(o_totalprice, 2)::DOUBLE END AS amount FROM orders")
def parsed_money(spark, d):
    blanks = F.translate(F.format_number(_cents("o_totalprice"), 2), ",.", " ,")
    said = F.when(c("o_orderkey") % 8 == 0, "даром").when(c("o_orderkey") % 2 == 0, _words("₽ ", blanks)).otherwise(_words(blanks, " руб."))
    return table(spark, d, "orders").select("o_orderkey", money.parse_money(said).alias("amount"))


@query("parsed_dates", """
WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN t - INTERVAL 3 HOURS WHEN 2 THEN date_trunc('day', t) WHEN 4 THEN NULL ELSE t END AS moment,
  CASE o_orderkey % 5 WHEN 2 THEN date_trunc('day', t) WHEN 4 THEN NULL ELSE t END AS bare, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN strftime(t, '%d.%m.%Y') || ' 00:00' WHEN 0 THEN strftime(t - INTERVAL 3 HOURS, '%d.%m.%Y %H:%M') ELSE strftime(t, '%d.%m.%Y %H:%M') END AS shown,
  CASE o_orderkey % 5 WHEN 4 THEN DATE '0001-01-01' ELSE t::DATE END AS sort_day
FROM o""")
def parsed_dates(spark, d):
    kind = c("o_orderkey") % 5
    o = table(spark, d, "orders").select("o_orderkey", (c("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(c("o_orderkey") % 1440).cast("int"))).alias("at"))
    said = F.when(kind == 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+03:00'")).when(kind == 1, F.date_format("at", "dd.MM.yyyy HH:mm")).when(kind == 2, F.date_format("at", "dd.MM.yyyy")).when(kind == 3, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).otherwise("скоро")
    o = o.select("o_orderkey", said.alias("said"))
    return o.select("o_orderkey", dates.parse("said").alias("moment"), dates.parse("said", keep_zone=False).alias("bare"), dates.display(dates.parse("said")).alias("shown"), dates.sort_key("said").cast("date").alias("sort_day"))


@query("parsed_month_names", "SELECT o_orderkey, o_orderdate + to_minutes(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1440 ELSE 0 END) AS moment FROM orders")
def parsed_month_names(spark, d):
    at, k = c("o_orderdate"), c("o_orderkey")
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(at))
    clock = F.when(k % 2 == 0, _words(", ", F.floor(k % 1440 / 60).cast("int"), ":", F.lpad((k % 60).cast("string"), 2, "0"))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", dates.parse_month_name(_words(F.dayofmonth(at), " ", month, " ", F.year(at), clock)).alias("moment"))


@query("lot_discounts", """
SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN round((p_size * 100 - p_partkey % 3000) / (p_size * 100) * 100, 2)::DOUBLE END AS discount, (p_size % 10 > 0)::INTEGER * p_size * 100 - p_partkey % 3000 AS profit,
  p_size % 3 = 0 AS review, CASE WHEN p_size % 4 > 2 THEN ['low', 'medium', 'high'][p_size % 3 + 1] ELSE ['low', 'low', 'medium'][p_size % 3 + 1] END AS weaker,
  abs((p_size % 10 > 0)::INTEGER * p_size * 100 - p_partkey % 3000) / greatest((p_size % 10 > 0)::INTEGER * p_size * 100, p_partkey % 3000, 1) > 0.05 AS apart
FROM part WHERE p_partkey % 3000 > 0""")
def lot_discounts(spark, d):
    n = c("p_size")
    p = table(spark, d, "part").where("p_partkey % 3000 > 0").select("p_partkey", F.when(n % 10 > 0, n * 100).otherwise(0).cast("double").alias("market"), (c("p_partkey") % 3000).cast("double").alias("price"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), n % 3 + 1).alias("confidence"), (n % 4).alias("evidence"))
    return p.select("p_partkey", money.discount_percent("market", "price").alias("discount"), money.profit("market", "price").cast("int").alias("profit"), money.needs_review("confidence").alias("review"), money.weaker_confidence(c("confidence"), c("evidence"), 3).alias("weaker"), money.prices_diverge("market", "price").alias("apart"))


_NOUNS = {"gear": ("Автомобиль", "car"), "gizmo": ("Квартира", "apartment"), "ring": ("Нежилое помещение", "commercial_room"), "bolt": ("Склад", "commercial_building"), "widget": ("Жилой дом", "house"), "plate": ("Земельный участок", "land"), "rod": ("Машино-место", "parking"), "anvil": ("Станок", "other")}


@query("categories_of_titles", "SELECT p_partkey, CASE split_part(p_name, ' ', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in _NOUNS.items()) + " END AS category FROM part")
def categories_of_titles(spark, d):
    noun = F.substring_index("p_name", " ", -1)
    title = _words(F.coalesce(*[F.when(noun == k, said) for k, (said, _) in _NOUNS.items()]), " ", c("p_brand"), " №", c("p_partkey"))
    return table(spark, d, "part").select("p_partkey", classify.category(title, F.lit("")).alias("category"))


@query("statuses_of_captions", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'closed' WHEN 'view' THEN 'active' WHEN 'signup' THEN 'scheduled' WHEN 'click' THEN 'active' ELSE 'unknown' END AS status,
  CASE event_type WHEN 'purchase' THEN 'closed' WHEN 'view' THEN 'active' WHEN 'signup' THEN 'scheduled' WHEN 'click' THEN 'active' ELSE 'unknown' END AS by_caption FROM events""")
def statuses_of_captions(spark, d):
    kind, day = c("event_type"), F.date_format("ts", "dd.MM")
    raw = F.when(kind == "purchase", "завершены").when(kind == "click", "Опубликовано").otherwise("")
    caption = F.when(kind == "view", _words("Осталось ", c("event_id") % 9 + 1, " дня")).when(kind == "signup", _words("Начало торгов ", day)).otherwise(_words("Лот ", c("event_id")))
    shown = F.when(kind == "purchase", _words("Торги завершены ", day)).when(kind == "view", _words("Прием заявок до ", day)).when(kind == "signup", _words("Начало торгов ", day)).otherwise(F.lit(""))
    e = table(spark, d, "events").select("event_id", raw.alias("raw"), F.array(caption).alias("captions"), F.array(shown).alias("shown"), F.when(kind == "click", "icon-green").otherwise("grey").alias("icon"))
    return e.select("event_id", classify.status_decision("raw", c("captions"))["final_status"].alias("status"), classify.status_of_captions(c("shown"), c("icon")).alias("by_caption"))


@query("ended_orders", f"""
SELECT o_orderkey, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderstatus = 'F' OR (o_orderkey % 3 > 0 AND o_orderdate + INTERVAL 30 DAYS <= TIMESTAMP '{CUT}') AS ended FROM orders""")
def ended_orders(spark, d):
    k, at = c("o_orderkey"), c("o_orderdate").cast("timestamp_ntz")
    ended = classify.ended(F.when(k % 11 == 0, True), F.when(k % 13 == 0, at), F.when(c("o_orderstatus") == "F", "closed").otherwise("active"), F.when(k % 3 > 0, at + F.expr("INTERVAL 30 DAYS")), cut())
    return table(spark, d, "orders").select("o_orderkey", ended.alias("ended"))


@query("client_keys", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 5 = 1 THEN -1 ELSE c_acctbal END AS amount_key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_name) END AS name_key FROM customer""")
def client_keys(spark, d):
    k = c("c_custkey")
    said = F.when(k % 5 == 0, None).when(k % 5 == 1, "x").otherwise(c("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", said.alias("said"), F.when(k % 4 > 0, c("c_name")).alias("name")).select("c_custkey", listing.sort_number("said").alias("amount_key"), listing.sort_text("name").alias("name_key"))


@query("deep_values", """
SELECT p_partkey, p_name AS named, p_brand || ', ' || p_type AS listed, p_size::VARCHAR AS pathed, CASE WHEN p_partkey % 2 = 0 THEN 'size|type' ELSE 'type' END AS changed FROM part""")
def deep_values(spark, d):
    inner = F.struct(F.struct(F.struct(c("p_name").alias("fullName")).alias("OWNER")).alias("l1"), F.array(F.struct(F.array("p_brand", "p_type").alias("marks"))).alias("rows"), F.struct(F.struct(c("p_size").alias("b")).alias("a")).alias("x"), F.struct(c("p_size").alias("b")).alias("a"))
    before = F.create_map(F.lit("name"), c("p_name"), F.lit("size"), c("p_size").cast("string"))
    after = F.create_map(F.lit("name"), c("p_name"), F.lit("size"), (c("p_size") + (c("p_partkey") % 2 == 0).cast("int")).cast("string"), F.lit("type"), c("p_type"))
    p = table(spark, d, "part").select("p_partkey", F.to_json(inner).alias("payload"), F.array_join(F.array_sort(F.map_keys(jsonwalk.map_difference(before, after))), "|").alias("changed"))
    return p.select("p_partkey", jsonwalk.deep_pick("payload", "owner").alias("named"), jsonwalk.deep_pick("payload", "marks").alias("listed"), jsonwalk.deep_pick("payload", "a.b").alias("pathed"), "changed")


@query("repaired_answers", """SELECT p_partkey, '{"brand": "' || p_brand || '", "sizes": [' || p_size || ', ' || p_partkey || ']}' AS fixed FROM part""")
def repaired_answers(spark, d):
    k = c("p_partkey")
    plain = _words('{"sizes": [', c("p_size"), ", ", k, '], "brand": "', c("p_brand"), '"}')
    loose = _words("Ответ: {brand: ", F.lit('"'), c("p_brand"), F.lit('"'), ", sizes: [", c("p_size"), ", ", k, ",],}")
    said = F.when(k % 3 == 0, _words("```json\n", plain, "\n```")).when(k % 3 == 1, loose).otherwise(plain)
    return table(spark, d, "part").select("p_partkey", jsonwalk.repaired_object(said).alias("fixed"))


@query("image_links", "SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/1.jpg|https://b.example/' || page_id || '.png' AS images FROM pages")
def image_links(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    payload = F.to_json(F.struct(F.struct(F.array(_words("//", host, "/1.jpg"), _words("https://b.example/", c("page_id"), ".png"), _words("ftp://", host)).alias("photos"), F.struct(c("url").alias("text")).alias("more")).alias("lot")))
    return table(spark, d, "pages").select("page_id", F.array_join(jsonwalk.image_urls(payload), "|").alias("images"))


@query("cleaned_texts", """
SELECT c_custkey, c_name || ' ' || c_mktsegment || ' 5 < ' || c_nationkey AS text, CASE WHEN c_custkey % 3 > 0 THEN c_custkey || '_' || c_nationkey ELSE c_nationkey::VARCHAR END AS joined, 'ab-' || c_custkey AS lot,
  c_custkey % 2 = 0 AS guid, c_custkey % 5 < 3 AS transient, CASE c_custkey % 4 WHEN 0 THEN 'Активен' WHEN 1 THEN 'Завершен' ELSE c_mktsegment END AS titled FROM customer""")
def cleaned_texts(spark, d):
    k, n = c("c_custkey"), c("c_nationkey")
    guid = F.when(k % 2 == 0, F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")).otherwise(F.md5(k.cast("string")))
    error = F.element_at(F.array(_words("HTTP 503 from ", k), _words("Read timed out after ", k), _words("Connection reset by ", k), _words("404 not found: ", n), _words("bad value ", n)), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", text.clean(_words("<p>", c("c_name"), "  <b>", c("c_mktsegment"), "</b>\n 5 < ", n, "</p>")).alias("text"), text.join_ids(F.when(k % 3 > 0, _words(" ", k, " ")), n.cast("string")).alias("joined"),
        text.lot_id_of_url(_words("https://x.example/lot/ab-", k, "?y=", n)).alias("lot"), text.is_guid(guid).alias("guid"), text.is_transient_error(error).alias("transient"), classify.label(F.when(k % 4 == 0, "active").when(k % 4 == 1, "closed").otherwise(c("c_mktsegment")), classify.STATUS_TITLES).alias("titled"),
    )


@query("rounded_cents", """
WITH l AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS n, l_quantity::INTEGER % 10 AS third FROM lineitem WHERE l_quantity::INTEGER % 10 <> 5)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (n + (third > 5)::INTEGER) / 100.0::DOUBLE AS cents, replace(rtrim(rtrim(printf('%.2f', n / 100.0::DOUBLE), '0'), '.'), '.', ',') AS shown FROM l""")
def rounded_cents(spark, d):
    n, third = F.round(c("l_extendedprice") * 100).cast("long"), c("l_quantity").cast("int") % 10
    l = table(spark, d, "lineitem").where(third != 5)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.cents((n * 10 + third) / 1000).cast("double").alias("cents"), money.query_number(n / 100, comma=True).alias("shown"))


@query("shape_centres", """
SELECT c_custkey, (6 * (c_nationkey + 0.5) + 12)::DOUBLE / 6 AS lon, round((6 * (c_custkey % 60)::DOUBLE + 9) / 6, 9) AS lat FROM customer""")
def shape_centres(spark, d):
    """Multi-polygons of two rings each: the mean of all their points, whatever the nesting."""
    x, y = c("c_nationkey") + F.lit(0.5), (c("c_custkey") % 60).cast("double")
    point = lambda dx, dy: F.array(x + dx, y + dy)
    rings = F.array(F.array(F.array(point(0.0, 0.0), point(2.0, 0.0), point(2.0, 3.0))), F.array(F.array(point(4.0, 3.0), point(4.0, 0.0), point(0.0, 3.0))))
    shape = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))
    return table(spark, d, "customer").select("c_custkey", geo.shape_centre(shape).alias("p")).select("c_custkey", "p.lon", F.round("p.lat", 9).alias("lat"))
