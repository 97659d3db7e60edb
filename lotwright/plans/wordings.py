"""Listings' wordings filled in from the tables' columns, and what the operators read from them.

Every query has a few wordings, as sources write them; a row takes one of them and fills in its own names, numbers and
dates. The SQL makes the results of the same columns and never sees the wordings, so it does not know the operators'
rules. `$name` stands for a column, or for one of DERIVED.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify, dates, extract, geo, jsonwalk, money, places, regions, text
from ..operators import links, listing, review
from ..sources import cards
from .catalogue import query
from .registry import table

_SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
_NAME = re.compile(r"\$([a-z]+(?:_[a-z]+)*)")
#: Columns made of part's in Spark and in SQL alike: a day and a code as two digits, a clock, a number of eight digits, a digest.
DERIVED = {
    "day": "lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0')",
    "clock": "concat(lpad(CAST(p_partkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(p_size AS STRING), 2, '0'))",
    "code": "lpad(CAST(p_size AS STRING), 2, '0')",
    "wide": "lpad(CAST(p_partkey AS STRING), 8, '0')",
    "digest": "substr(md5(CAST(p_partkey AS STRING)), 1, 12)",
}


def _fields(ddl: str) -> list[list[str]]:
    return [f.split() for f in ddl.split(", ")] if ddl else []


def _pieces(said: str) -> list[tuple[bool, str]]:
    """The parts of a wording: (whether it is a column, text or name)."""
    return [(n % 2 == 1, x) for n, x in enumerate(_NAME.split(said)) if x]


def _filled(said, type_name: str) -> Column:
    """A wording as a column; of other types than text, a string is an expression."""
    if type_name != "string" or said is None:
        return (F.expr(said) if isinstance(said, str) else F.lit(said)).cast(type_name)
    return F.concat(F.lit(""), *[F.col(x).cast("string") if is_column else F.lit(x) for is_column, x in _pieces(said)])


def _filled_sql(said, type_name: str) -> str:
    """The same in SQL."""
    if said is None:
        return "NULL"
    if not isinstance(said, str) or type_name != "string":
        return f"({said})"
    return " || ".join(["''", *[f"CAST({x} AS VARCHAR)" if is_column else "'" + x.replace("'", "''") + "'" for is_column, x in _pieces(said)]])


def _chosen(kind: Column, values: list[Column]) -> Column:
    out = F.when(kind == 0, values[0])
    for n, v in enumerate(values[1:], 1):
        out = out.when(kind == n, v)
    return out


def worded(df, ddl: str, wordings: list[tuple]):
    """p_partkey with the columns of ddl, each filled in from the row's wording."""
    whole = df.select("*", *[F.expr(e).alias(n) for n, e in DERIVED.items()])
    kind = F.col("p_partkey") % len(wordings)
    return whole.select("p_partkey", *[_chosen(kind, [_filled(w[i], t) for w in wordings]).alias(n) for i, (n, t) in enumerate(_fields(ddl))])


def worded_sql(ddl: str, wordings: list[tuple]) -> str:
    made = []
    for i, (n, t) in enumerate(_fields(ddl)):
        made.append(f"CAST(CASE p_partkey % {len(wordings)} " + " ".join(f"WHEN {k} THEN {_filled_sql(w[i], t)}" for k, w in enumerate(wordings)) + f" END AS {_SQL_TYPES[t]}) AS {n}")
    return f"SELECT p_partkey, {', '.join(made)} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in DERIVED.items())} FROM part)"


def by_wording(name: str, inputs: str, results: str, wordings: list[tuple], *columns) -> None:
    """Register a query: inputs and results are columns with types, wordings rows of both, columns the results' expressions."""
    given, wanted = _fields(inputs), _fields(results)

    @query(name, worded_sql(results, [w[len(given) :] for w in wordings]))
    def run(spark, d):
        said = worded(table(spark, d, "part"), inputs, wordings)
        return said.select("p_partkey", *[make().cast(t).alias(n) for make, (n, t) in zip(columns, wanted, strict=True)])


def _list(c):
    return F.array_join(c, "|")


c = F.col

by_wording("category_rules", "title string, body string", "category string", [
    ("Автомобиль $p_brand", None, "car"), ("Квартира $p_size кв.м", "$p_name", "apartment"), ("Нежилое помещение $p_partkey", None, "commercial_room"), ("Здание склада $p_name", "с земельным участком $p_size", "commercial_building_with_land"),
    ("Склад $p_partkey", "кирпичный, $p_size м", "commercial_building"), ("Жилой дом $p_size", "деревянный", "house"), ("Земельный участок $p_partkey", "$p_size соток", "land"), ("Машино-место $p_size", None, "parking"),
    ("Объект $p_name незавершенный", None, "unfinished"), ("Имущественный комплекс $p_name", None, "complex"), ("Право требования к ООО $p_brand", None, "receivable"), ("Недвижимое имущество $p_partkey", None, "real_estate"), (None, "Станок токарный $p_type", "other"),
], lambda: classify.category("title", "body"))

by_wording("source_category", "code string, name string, title string", "category string", [
    ("7", "$p_name", "Квартира $p_size", "land"), ("99$p_size", "Транспорт и техника $p_brand", "Квартира", "transport"), (None, "Земельные участки и здания $p_size", "x", "commercial_building_with_land"), (None, "Земельные участки $p_size", "x", "land"),
    (None, "Недвижимость $p_type", "x", "real_estate"), (None, None, "Квартира в доме $p_partkey", "apartment"), ("99", "Прочее $p_name", "Станок", "other"),
], lambda: classify.category_of_source("code", {"7": "land"}, "name", "title", F.lit(None).cast("string")))

by_wording("catalogue_status", "said string", "status string", [
    ("Опубликован $day.02", "active"), ("<b>Приём заявок</b> $p_name", "active"), ("Торги $p_partkey завершены", "closed"), ("Торги $p_partkey не состоялись", "closed"), ("Аннулирован $day.03", "closed"), ("Торги назначены на $day.04", "scheduled"),
    ("Ожидает $p_name", "scheduled"), ("  ", "unknown"), (None, "unknown"), ("прочее $p_name", "unknown"),
], lambda: classify.catalogue_status("said"))

by_wording("status_decision", "raw string, captions string", "status string, confidence string, trace string", [
    ("завершены", "Лот $p_partkey", "closed", "medium", "from status and dates: завершены лот $p_partkey"), ("", "Осталось $p_size дня", "active", "medium", "from status and dates:  осталось $p_size дня"),
    (None, "Начало торгов $day.02", "scheduled", "medium", "from status and dates:  начало торгов $day.02"), ("Опубликовано", "Начало торгов;$clock", "active", "medium", "from status and dates: опубликовано начало торгов $clock"),
    ("?", "$p_size", "unknown", "medium", "from status and dates: ? $p_size"),
], *[lambda f=f: classify.status_decision("raw", F.split("captions", ";"))[f] for f in ("final_status", "confidence", "trace_reason")])

by_wording("caption_status", "captions string, icon string", "status string", [
    ("Прием заявок до $day.06", "red", "active"), ("Начало торгов $day.06;завершен", "green", "scheduled"), ("Торги $p_partkey завершены", "green", "closed"), ("$p_size", "icon-Green", "active"), (None, "$p_name", "unknown"), ("до окончания $p_size дня;Начало торгов", None, "active"),
], lambda: classify.status_of_captions(F.split("captions", ";"), "icon"))

by_wording("label_translation", "status string, category string", "status_title string, category_title string", [
    ("active", "land", "Активен", "Земельный участок"), ("closed", "$p_type", "Завершен", "$p_type"), ("$p_name", "commercial_building_with_land", "$p_name", "Нежилое здание + ЗУ"), ("pending", "$p_brand", "Ожидается", "$p_brand"), ("unknown", "other", "Неизвестно", "Прочее"),
], lambda: classify.label("status", classify.STATUS_TITLES), lambda: classify.label("category", classify.CATEGORY_TITLES))

by_wording("text_cleanup", "said string", "text string", [
    ("<p>$p_name  <b>$p_brand</b></p>", "$p_name $p_brand"), (" $p_size \n $p_type ", "$p_size $p_type"), (None, ""), ("$p_partkey<br/>$p_size", "$p_partkey $p_size"), ("$p_size < $p_partkey", "$p_size < $p_partkey"),
], lambda: text.clean("said"))

by_wording("cyrillic_slugs", "said string", "slug string", [
    ("Щёлково, Московская обл., $p_partkey", "schelkovo-moskovskaya-obl-$p_partkey"), ("Объект №$p_partkey", "obekt-$p_partkey"), ("Жуков Цех ($p_size)", "zhukov-ceh-$p_size"), ("", "online"), (None, "online"), ("-- $p_size --", "$p_size"),
], lambda: text.slug("said"))

by_wording("composed_ids", "a string, b string, url string", "joined string, lot string, digest string", [
    ("$p_partkey", " $p_size ", "https://x.example/lot/ab-$p_partkey?y=2", "$p_partkey_$p_size", "ab-$p_partkey", "$digest"), ("", None, "https://x.example/lots/$p_size", None, None, "$digest"), (None, "$p_name", "/lot/$p_partkey/", "$p_name", "$p_partkey", "$digest"),
], lambda: text.join_ids("a", "b"), lambda: text.lot_id_of_url("url"), lambda: F.substring(F.md5(c("p_partkey").cast("string")), 1, 12))

by_wording("mojibake_repair", "said string", "text string", [
    ("Москва".encode().decode("latin-1") + " $p_name", "Москва $p_name"), ("plain $p_size", "plain $p_size"), ("Москва $p_partkey", "Москва $p_partkey"), (None, None), ("Ðx $p_name", "Ðx $p_name"),
], lambda: text.repair_mojibake("said"))

by_wording("guid_test", "said string", "guid boolean", [
    ("$wide-1b2c-4d3e-9f00-aabbccddeeff", True), (" $wide-1B2C-4D3E-9F00-AABBCCDDEEFF ", True), ("$wide1b2c4d3e9f00aabbccddeeff", False), (None, False), ("г. Ярославль, $p_name", False),
], lambda: text.is_guid("said"))

by_wording("error_class", "said string", "transient boolean", [
    ("Read timed out after $p_size s", True), ("Connection reset by $p_name", True), ("HTTP 503 ($p_brand)", True), ("429 Too Many Requests: $p_type", True), ("404 not found: $p_name", False), (None, False),
], lambda: text.is_transient_error("said"))

by_wording("labelled_prices", "said string", "price double, rule string, confidence string", [
    ("Текущая цена: $p_size 250 000 руб.", "p_size * 1000000 + 250000", "price.current_price", "high"), ("Начальная цена $wide ₽, текущая цена 1$wide ₽", "100000000 + p_partkey", "price.current_price", "high"), ("Стартовая цена лота 9$p_size,5 руб", "CAST(concat('9', p_size, '.5') AS DOUBLE)", "price.start_price", "high"),
    ("Цена продажи 7$wide рублей", "700000000 + p_partkey", "price.sale_price", "medium"), ("Стоимость: 3$wide руб", "300000000 + p_partkey", "price.generic_price", "medium"), ("Продаётся за $p_size 000 руб.", "p_size * 1000", "price.single_currency_amount", "low"),
    ("1$wide руб. или 2$wide руб.", None, "price.ambiguous_currency_amounts", "none"), ("", None, "price.empty", "none"), (None, None, "price.empty", "none"), ("без цены, $p_name", None, "price.not_found", "none"),
], *[lambda f=f: extract.price("said")[f] for f in ("value", "rule_id", "confidence")])

by_wording("labelled_areas", "said string", "area double, rule string, building double, room double", [
    ("Нежилое здание общей площадью 5$p_size,5 кв.м", "CAST(concat('5', p_size, '.5') AS DOUBLE)", "area.building_labeled", "CAST(concat('5', p_size, '.5') AS DOUBLE)", None), ("Помещение площадью 3$p_size м2", "CAST(concat('3', p_size) AS DOUBLE)", "area.room_labeled", None, "CAST(concat('3', p_size) AS DOUBLE)"),
    ("Объект 7$p_size кв. м", "CAST(concat('7', p_size) AS DOUBLE)", "area.single_unlabeled", None, None), ("1$p_size м2 и 2$p_size м2", None, "area.ambiguous_multiple", None, None), ("", None, "area.empty", None, None), ("нет, $p_name", None, "area.not_found", None, None),
    ("Жилой дом: 9$p_size м²; участок 6$p_size кв.м", "CAST(concat('9', p_size) AS DOUBLE)", "area.building_labeled", "CAST(concat('9', p_size) AS DOUBLE)", None),
], lambda: extract.area("said")["value"], lambda: extract.area("said")["rule_id"], lambda: extract.building_area("said"), lambda: extract.room_area("said"))

by_wording("land_areas", "said string", "area double", [
    ("Земельный участок площадью $p_size соток", "p_size * 100"), ("земельного участка общей площадью $p_size,5 га", "p_size * 10000 + 5000"), ("Земельный участок: 6$p_size кв.м", "CAST(concat('6', p_size) AS DOUBLE)"), ("Площадь участка 1$p_size сот.", "CAST(concat('1', p_size) AS DOUBLE) * 100"), ("Здание 5$p_size м2", None), (None, None),
], lambda: extract.land_area("said"))

by_wording("cadastral_numbers", "said string, more string", "found string, valid string", [
    ("Участки 76:23:010101:1$p_size и 76:23:010101:1$p_size, 77:01:0001001:5$p_partkey", "7:2:0101:$p_size", "76:23:010101:1$p_size|77:01:0001001:5$p_partkey", "7:2:0101:$p_size"), ("нет $p_partkey", "bad $p_size", "", ""),
    (None, " 76:23: 010101:1$p_size ", "", "76:23:010101:1$p_size"), ("76:23:010101:7$p_size", None, "76:23:010101:7$p_size", ""),
], lambda: _list(extract.cadastral_numbers("said")), lambda: _list(extract.cadastral_set(c("more"), F.lit(None).cast("array<string>"))))

by_wording("addresses", "said string", "address string", [
    ("Адрес: г. Ярославль, ул. Свободы, д. $p_partkey Кадастровый номер 76:23", "г. Ярославль, ул. Свободы, д. $p_partkey"), ("расположено по адресу: Московская обл., г. Клин, ул. Мира, $p_size", "Московская обл., г. Клин, ул. Мира, $p_size"), ("Адрес: кратко $p_size", None), (None, None),
], lambda: extract.address("said"))

by_wording("building_facts", "said string", "floors int, built int, commissioned int, heritage boolean, legal string", [
    ("$p_size этажей, год постройки: 19$day, год ввода: 20$day. Объект культурного наследия", "p_size", "1900 + p_size % 28 + 1", "CASE WHEN p_size % 28 + 1 <= 27 THEN 2000 + p_size % 28 + 1 END", True, None), ("Банкротство: здание 1700 г., лот $p_name", None, None, None, False, "банкротные торги"),
    ("введено в эксплуатацию в 19$day, госимущество $p_type", None, None, "1900 + p_size % 28 + 1", False, "продажа гос. имущества"), (None, None, None, None, False, None),
], lambda: extract.floors("said"), lambda: extract.year_built("said", F.lit(2026)), lambda: extract.year_commissioned("said", F.lit(2026)), lambda: extract.is_heritage("said"), lambda: extract.legal_status("said"))

by_wording("money_parse", "said string", "amount double", [
    ("$p_size 250 000,50 руб.", "p_size * 1000000 + 250000.5"), ("₽ 9$p_partkey", "CAST(concat('9', p_partkey) AS DOUBLE)"), ("цена $p_size.5", "p_size + 0.5"), ("даром, $p_name", None), (None, None),
], lambda: money.parse_money("said"))

by_wording("model_json_repair", "said string", "fixed string", [
    ('```json\n{"a": $p_size}\n```', '{"a": $p_size}'), ("Ответ: {a: $p_size, b: [$p_partkey, 2,],}", '{"a": $p_size, "b": [$p_partkey, 2]}'), ("нет $p_name", None), (None, None), ('{"b": "$p_name", "a": {"c": null}}', '{"a": {"c": null}, "b": "$p_name"}'),
], lambda: jsonwalk.repaired_object("said"))

_AT = "CAST(concat('2026-05-', day, ' ', clock, ':00') AS TIMESTAMP)"
by_wording("date_formats", "said string", "moment timestamp_ntz, bare timestamp_ntz, shown string", [
    ("2026-05-$dayT10:00:00+03:00", "CAST(concat('2026-05-', day, ' 07:00:00') AS TIMESTAMP)", "CAST(concat('2026-05-', day, ' 10:00:00') AS TIMESTAMP)", "$day.05.2026 07:00"), ("$day.05.2026 $clock", _AT, _AT, "$day.05.2026 $clock"),
    ("$day.05.2026", "CAST(concat('2026-05-', day) AS TIMESTAMP)", "CAST(concat('2026-05-', day) AS TIMESTAMP)", "$day.05.2026 00:00"), ("2026-05-$day $clock:00", _AT, _AT, "$day.05.2026 $clock"), ("$day.05.2026 $clock (МСК)", None, None, None), ("скоро, $p_name", None, None, None), (None, None, None, None),
], lambda: dates.parse("said"), lambda: dates.parse("said", keep_zone=False), lambda: dates.display(dates.parse("said")))

by_wording("month_names", "said string", "moment timestamp_ntz, sort_key string", [
    ("$day мая 2026, $clock", _AT, "0001-01-01"), ("$day декабря 2025", "CAST(concat('2025-12-', day) AS TIMESTAMP)", "0001-01-01"), ("$day.02.2026", None, "2026-02-$day"), (None, None, "0001-01-01"),
], lambda: dates.parse_month_name("said"), lambda: F.date_format(dates.sort_key("said"), "yyyy-MM-dd"))

by_wording("discount_and_profit", "market double, price double", "discount double, profit double", [
    ("p_size * 8", "p_size * 6", 25.0, "p_size * 2"), ("p_size * 10", "p_size * 13", -30.0, "p_size * -3"), (0.0, "p_size", None, "-p_size"), (None, "p_size", None, None), ("p_size * 3", "p_size * 2", 33.33, "p_size"), ("p_partkey + 1", 0.0, None, "p_partkey + 1"),
], lambda: money.discount_percent("market", "price"), lambda: money.profit("market", "price"))

by_wording("review_and_confidence", "confidence string, evidence int, a double, b double", "review boolean, weaker string, apart boolean", [
    ("low", "p_size % 3", "p_size * 100", "p_size * 106", True, "low", True), ("high", "p_size % 3", "p_size * 100", "p_size * 104", False, "medium", False), ("medium", 1, None, "p_size", False, "low", False), ("high", "p_size + 2", "p_size", "p_size", False, "high", False), ("Низкая", "p_size + 2", 0.0, "p_size / 1250.0", True, "Низкая", False),
], lambda: money.needs_review("confidence"), lambda: money.weaker_confidence(c("confidence"), c("evidence"), 3), lambda: money.prices_diverge("a", "b"))

by_wording("cents", "amount double", "cents double, query_number string, comma_number string", [
    ("p_size + 0.125", "p_size + 0.13", "$p_size.125", "$p_size,125"), ("p_size + 0.5", "p_size + 0.5", "$p_size.5", "$p_size,5"), ("p_partkey", "p_partkey", "$p_partkey", "$p_partkey"), ("-p_size - 0.375", "-p_size - 0.38", "-$p_size.375", "-$p_size,375"), (None, None, None, None),
], lambda: money.cents("amount").cast("double"), lambda: money.query_number("amount"), lambda: money.query_number("amount", comma=True))

_EVALUATION = "price double, low double, high double, confidence string, why string, links string, risk int, advice string, days string"
_ADVICE_SAID = f"{money.DISCLAIMER}\n\n$p_name\n\nОжидаемый срок продажи: $p_size months"
by_wording("evaluation_validity", _EVALUATION, "problems string, said string", [
    ("p_size", "p_size / 2.0", "p_size * 2", "high", "$p_type", "https://a.example/$p_partkey", "p_size % 10 + 1", "$p_name", "$p_size months", "", _ADVICE_SAID),
    ("p_size * 3", "p_size / 2.0", "p_size * 2", "sure", "", "http://a.example/$p_partkey", "p_size + 10", "$p_name", "$p_size months", "range|confidence|explanation|links|risk", _ADVICE_SAID),
    ("-p_size", "-p_size * 2", "p_size", "low", "$p_type", "https://localhost/$p_partkey", "p_size % 10 + 1", "", "$p_size months", "price|links|recommendation", f"{money.DISCLAIMER}\n\n\n\nОжидаемый срок продажи: $p_size months"),
    (None, "p_size", "p_size * 2", "low", "$p_type", None, "p_size % 10 + 1", "$p_name", "$p_size months", "price|range", _ADVICE_SAID),
], lambda: _list(money.evaluation_problems(c("price"), c("low"), c("high"), c("confidence"), c("why"), F.split("links", " "), c("risk"), c("advice"), c("days"))), lambda: money.advice_text(c("advice"), c("days")))

by_wording("deep_json", "payload string", "found string, listed string, pathed string", [
    ('{"first":{"l1":{"key":"$p_name"}},"second":{"key":"shallow"}}', "$p_name", None, None), ('{"KEY":{"fullName":"$p_brand"}}', "$p_brand", None, None), ('{"a":[{"key":["$p_name","$p_type"]}],"list":["$p_brand","q"]}', "$p_name, $p_type", "$p_brand, q", None), ('{"a":{"b":"in $p_size"},"z":{"a":{"b":"not"}}}', None, None, "in $p_size"),
    ("broken $p_name", None, None, None), (None, None, None, None),
], *[lambda k=k: jsonwalk.deep_pick("payload", k) for k in ("key", "list", "a.b")])

by_wording("json_changes", "before string, after string", "changed string", [
    ('{"a":"$p_name","b":"$p_size"}', '{"a":"$p_name","b":"$p_size.","c":"4"}', "b|c"), ("{}", "{}", ""), ('{"x":"$p_partkey"}', "{}", "x"), ('{"x":"$p_size","y":"$p_brand"}', '{"y":"$p_brand","x":"$p_size"}', ""),
], lambda: _list(F.array_sort(F.map_keys(jsonwalk.map_difference(F.from_json("before", "map<string,string>"), F.from_json("after", "map<string,string>"))))))

by_wording("image_addresses", "payload string", "images string", [
    ('{"photos":["//a.example/$p_partkey.jpg","https://b.example/$p_size.png","ftp://c"]}', "https://a.example/$p_partkey.jpg|https://b.example/$p_size.png"), ('{"lot":{"image":{"url":"https://x.example/$p_partkey"},"text":"https://no"}}', "https://x.example/$p_partkey"), ("{}", ""), (None, ""),
], lambda: _list(jsonwalk.image_urls("payload")))

by_wording("real_estate_predicates", "category string, said string", "real boolean, sale boolean", [
    ("land", "$p_name", True, True), ("car", "квартира $p_size", False, False), (None, "Квартира $p_size на продажу", True, True), (None, "Право аренды здания: аренда $p_partkey", True, False), ("apartment", "1/2 доля в праве, $p_size", True, False), ("other", "Станок $p_brand", False, False),
    ("house", "Памятник архитектуры, объект культурного наследия $p_name", True, False),
], lambda: classify.is_real_estate("category", "said"), lambda: classify.is_sale_real_estate("category", "said"))

by_wording("ended_lots", "archived boolean, closed string, status string, auction string", "ended boolean", [
    ("p_size > 0", None, "active", None, True), (None, "2026-01-$day", "active", None, True), (False, None, "closed", "2027-02-$day", True), (False, None, "active", "2025-01-$day", True), (False, None, "active", "2027-01-$day", False), (None, None, None, None, False),
], lambda: classify.ended(c("archived"), c("closed").cast("timestamp_ntz"), c("status"), c("auction").cast("timestamp_ntz"), F.lit("2026-06-01").cast("timestamp_ntz")))

by_wording("region_inference", "name string, number string, address string", "region string", [
    ("  Тверская область $p_size ", "76:1:1:1", None, "Тверская область $p_size"), ("", "76:23:010101:$p_partkey", "Москва", "Ярославская область"), (None, "5:1:1:$p_size", None, "Республика Дагестан"), (None, None, "Россия, САМАРСКАЯ ОБЛАСТЬ, Тольятти, $p_name", "Самарская область"), (None, "x$p_size", "где-то, $p_name", "Регион не определён"),
], lambda: places.region_label("name", "number", "address"))

by_wording("subject_match", "number string, address string", "matches boolean", [
    ("76:23:1:$p_partkey", "$p_name", True), (None, "Ярославская область, Рыбинск, $p_size", True), (None, "$p_name yaroslavskaya-oblast", True), ("77:1:1:$p_partkey", "Москва, $p_name", False), (None, None, False),
], lambda: places.in_subject("76", "Ярославская область", "number", "address"))

by_wording("lookup_queries", "said string", "asked string", [
    ("76:23:010101:1$p_size", "76:23:010101:1$p_size"), ("ул. Свободы, $p_partkey", "Ярославль, ул. Свободы, $p_partkey"), ("г. Москва, Арбат, $p_size", "г. Москва, Арбат, $p_size"), ("", ""), (None, ""),
], lambda: places.lookup_query("said"))

by_wording("geojson", "said string", "geometry string", [
    ('{"type":"Point","coordinates":[$p_size.5,$p_partkey],"crs":"x"}', '{"type":"Point","coordinates":[$p_size.5,$p_partkey]}'), ('{"type":"$p_name"}', None), ('{"coordinates":[$p_size]}', None), (None, None),
], lambda: places.geojson("said"))

by_wording("register_attributes", "props string, number string", "number_found string, address string, area string", [
    ('{"cad_num":"1:$p_partkey","readableAddress":"ул. $p_name","options":{"area":$p_size}}', "9", "1:$p_partkey", "ул. $p_name", "$p_size"), ('{"options":{"cn":"3:$p_partkey","address":"$p_brand"},"address":""}', "9", "3:$p_partkey", "$p_brand", None), ("{}", "9:$p_size", "9:$p_size", None, None),
], *[lambda n=n: places.register_attributes("props", "number")[n] for n in ("Кадастровый номер", "Адрес", "Площадь общая")])

by_wording("unresolved_places", "address string, place string", "used string, lat double, to_check boolean", [
    ("$p_name", "$p_brand", "$p_name", None, True), ("", "$p_brand", "$p_brand", None, True), (None, None, "", None, True),
], *[lambda f=f: places.unresolved("address", "place")[f] for f in ("address_used", "centroid_lat", "needs_geo_check")])

by_wording("ring_centres", "ring string", "lat double, lon double", [
    ("[[0,0],[$p_size,0],[$p_size,2],[0,2]]", 1.0, "p_size / 2.0"), ("[[$p_partkey,$p_size]]", "p_size", "p_partkey"), ("[]", None, None),
], *[lambda f=f: geo.ring_centre(F.from_json("ring", "array<array<double>>"))[f] for f in ("lat", "lon")])

by_wording("feature_choice", "features string, number string", "chosen string", [
    ("$p_name|$p_brand 76:$p_partkey;", "76:$p_partkey;", "$p_brand 76:$p_partkey;"), ("$p_name|$p_brand", "no:$p_size", "$p_name"), (None, "$p_size", None),
], lambda: review.fitting_feature(F.split("features", r"\|"), c("number")))

by_wording("address_match_score", "asked string, named string", "score int", [
    ("Ярославль, улица $p_name", "$p_name улица, Ярославль, Россия", 4), ("Ярославская $p_size", "Ярославский $p_size", 1), ("Клин $p_name", "Тверь $p_brand", 0),
], lambda: geo.candidate_score(c("asked"), c("named")))

by_wording("address_candidates", "said string, region string", "asked string", [
    ("Ярославская область, м. р-н Угличский, с. п. Слободское, с. Ефремово-$p_size, с земельным участком", None, "Ярославская область, Угличский муниципальный округ, село Ефремово-$p_size|Ефремово-$p_size, Угличский муниципальный округ, Ярославская область|Ефремово-$p_size, Ярославская область"),
    ("Рязанская обл., г. Сасово, ул. Ленина, д. $p_partkey", None, "Рязанская область, город Сасово, улица Ленина, дом $p_partkey|$p_partkey, улица Ленина, Сасово, Рязанская область|Сасово, Рязанская область"),
    ("п. Борок-$p_size, Некоузский район...", "Ярославская область", "поселок Борок-$p_size, Некоузский муниципальный округ, Ярославская область|Борок-$p_size, Некоузский муниципальный округ, Ярославская область|Борок-$p_size, Ярославская область"),
    ("", "Тверская область", ""), (None, None, ""),
], lambda: _list(geo.address_candidates("said", "region")))

by_wording("client_sort_keys", "amount string, name string, moment string", "amount_key double, name_key string, moment_key string", [
    ("$p_size.5", "Ёж $p_name", "$day.05.2026 $clock", "p_size + 0.5", "ёж $p_name", "2026-05-$day"), (None, None, None, -1.0, "", "0001-01-01"), ("x$p_size", "ABC $p_size", "2026-05-$dayT08:00:00+03:00", -1.0, "abc $p_size", "2026-05-$day"), ("$p_partkey", "", "скоро", "p_partkey", "", "0001-01-01"),
], lambda: listing.sort_number("amount"), lambda: listing.sort_text("name"), lambda: F.date_format(dates.sort_key("moment"), "yyyy-MM-dd"))

by_wording("paginators", "page string", "numbers string", [
    ("<div class='ty-pagination'><a href='?page=2'>2</a><a href='?a=$p_partkey&page=10$p_size'>11</a><a href='?page=2'>next</a></div>", "2|10$p_size"), ("<a href='?page=$p_size'>5</a>", ""), (None, ""),
], lambda: _list(F.transform(cards.page_numbers_of("page"), lambda n: n.cast("string"))))

_GOOD_PRICES, _GOOD_RISK = '"min_price": 0.5, "max_price": 1000', '{"risk_score": 3, "recommendation": "$p_name", "time_to_sell": "$p_size months"}'
_SHOWN = f"{money.DISCLAIMER}\n\n$p_name\n\n{money.REVIEW_NOTE}\n\nОжидаемый срок продажи: $p_size months"
by_wording("model_assessments", "market string, risk string, sparse boolean", "price double, confidence string, explanation string, advice string, problems string", [
    ('{"market_price": $p_size.125, ' + _GOOD_PRICES + ', "confidence": "high", "explanation": "$p_type", "links": ["https://a.example/$p_partkey"]}', _GOOD_RISK, False, "p_size + 0.13", "high", "$p_type", _SHOWN, ""),
    ("```json\n{market_price: $p_size, " + _GOOD_PRICES + ', "confidence": "high", "explanation": "$p_type",}\n```', _GOOD_RISK, False, "p_size", "low", f"{money.SPARSE_NOTE} $p_type", _SHOWN, ""),
    ('{"market_price": 2$wide, ' + _GOOD_PRICES + ', "confidence": "sure", "explanation": "$p_type", "links": ["http://a.example/$p_partkey"]}', '{"risk_score": 30, "recommendation": "$p_name"}', True, "200000000 + p_partkey", "low", f"{money.SPARSE_NOTE} $p_type", None, "range|confidence|links|risk|time_to_sell"),
    ("none $p_name", None, None, None, "low", None, None, "price|range|confidence|explanation|risk|recommendation|time_to_sell"),
], *[lambda n=n: money.assessment(jsonwalk.repaired_object("market"), c("risk"), c("sparse"))[n] for n in ("market_price", "confidence", "explanation", "advice")], lambda: _list(money.assessment(jsonwalk.repaired_object("market"), c("risk"), c("sparse"))["problems"]))

by_wording("source_backfill", "source string", "system string, region string", [
    ("town:$p_name", "towns", "$p_name"), ("town:", "towns", None), ("$p_brand", "$p_brand", None), (None, None, None),
], *[lambda f=f: links.source_parts("source", "town:", "towns")[f] for f in ("system", "region")])

by_wording("kept_statuses", "raw string, existing string", "status string, kept boolean", [
    ("завершены $p_name", "active", "closed", False), ("$p_size", "$p_type", "$p_type", True), ("$p_size?", "unknown", "unknown", False), (None, None, "unknown", False), ("", "", "unknown", False),
], *[lambda f=f: f(classify.kept_status(classify.status_decision("raw", F.array().cast("array<string>")), "existing")) for f in (lambda s: s["final_status"], lambda s: F.endswith(s["trace_reason"], F.lit("preserved.")))])

_FOUND = "<article>76:01:000001:$p_partkey0 <a href='/lot/1'>x</a></article><article>№ 76:01:000001:$p_partkey <a href='/news/5'>n</a><a href='/lot/$p_partkey/#top'>x</a></article>"
by_wording("cross_site_lookup", "html string, number string", "url string", [
    (_FOUND, "76:01:000001:$p_partkey", "/lot/$p_partkey/"), (_FOUND, " 76:01: 000001:$p_partkey", "/lot/$p_partkey/"), (_FOUND, "76:01:000002:$p_partkey", None), ("<article>76:01:000001:$p_partkey</article>", "76:01:000001:$p_partkey", None), (None, "76:01:000001:$p_partkey", None), (_FOUND, None, None),
], lambda: cards.found_by_number(c("html"), c("number")))

by_wording("lot_pages", "html string", "images string, links int, number string", [
    ("""<div id="lot-gallery" data-gallery='[{"url":"/$p_partkey.png"},{"src":"/$p_size-2.png"},{"url":"/$p_partkey.png"},3]'></div><a href="https://x.example/lots/lot/$p_partkey">$p_name</a> РАД: $wide-2024-0001-3""", "/$p_partkey.png|/$p_size-2.png", 1, "$wide-2024-0001-3"),
    ("<div id='lot-gallery' data-gallery='broken $p_name'></div>", "", 0, None), (None, "", 0, None),
], lambda: _list(cards.lot_page_of("html")["images"]), lambda: F.size(cards.lot_page_of("html")["links"]), lambda: cards.lot_page_of("html")["procedure_number"])

_REGIONS = [
    ("Респ Адыгея", "01"), ("КБР", "07"), ("  якутия", "14"), ("г. Москва", "77"), ("ЯРОСЛАВСКАЯ ОБЛАСТЬ", "76"), ("ХМАО", "86"), ("Атлантида $p_name", None), ("$p_size", "$code"),
]


@query("region_names", worded_sql("region_code string", [w[1:] for w in _REGIONS]))
def region_names(spark, d):
    return regions.with_region(worded(table(spark, d, "part"), "said string", _REGIONS), "said").select("p_partkey", "region_code")
