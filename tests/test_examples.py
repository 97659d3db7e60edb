"""Operators on the listings' own language over stated inputs and what each must give."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import classify, dates, extract, geo, jsonwalk, money, places, text
from lotwright.operators import links, listing, review
from lotwright.sources import cards

CASES = {}


def by_example(name, inputs, results, examples, *columns):
    """inputs and results: columns with types; examples: rows of both; columns: the results' expressions."""
    CASES[name] = inputs, results, examples, columns


def _fields(ddl):
    return [f.split() for f in ddl.split(", ")]


def _list(c):
    return F.array_join(c, "|")


c = F.col

by_example("category_rules", "title string, body string", "category string", [
    ("Автомобиль LADA", None, "car"), ("Квартира 45 кв.м", "", "apartment"), ("Нежилое помещение", None, "commercial_room"), ("Здание склада", "с земельным участком", "commercial_building_with_land"),
    ("Склад", "кирпичный", "commercial_building"), ("Жилой дом", "деревянный", "house"), ("Земельный участок", "10 соток", "land"), ("Машино-место", None, "parking"), ("Объект незавершенный", None, "unfinished"),
    ("Имущественный комплекс", None, "complex"), ("Право требования к ООО", None, "receivable"), ("Недвижимое имущество", None, "real_estate"), (None, "Станок токарный", "other"),
], lambda: classify.category("title", "body"))

by_example("source_category", "code string, name string, title string", "category string", [
    ("7", None, "Квартира", "land"), ("99", "Транспорт и техника", "Квартира", "transport"), (None, "Земельные участки и здания", "x", "commercial_building_with_land"), (None, "Земельные участки", "x", "land"),
    (None, "Недвижимость", "x", "real_estate"), (None, None, "Квартира в доме", "apartment"), ("99", "Прочее", "Станок", "other"),
], lambda: classify.category_of_source("code", {"7": "land"}, "name", "title", F.lit(None).cast("string")))

by_example("catalogue_status", "said string", "status string", [
    ("Опубликован", "active"), ("Приём заявок", "active"), ("Торги завершены", "closed"), ("Торги не состоялись", "closed"), ("Аннулирован", "closed"), ("Торги назначены", "scheduled"), ("Ожидает", "scheduled"), ("  ", "unknown"), (None, "unknown"), ("прочее", "unknown"),
], lambda: classify.catalogue_status("said"))

by_example("status_decision", "raw string, captions string", "status string, confidence string", [
    ("завершены", "", "closed", "medium"), ("", "Осталось 3 дня", "active", "medium"), (None, "Начало торгов 01.02", "scheduled", "medium"), ("Опубликовано", "Начало торгов", "active", "medium"), ("?", "", "unknown", "medium"),
], lambda: classify.status_decision("raw", F.split("captions", ";"))["final_status"], lambda: classify.status_decision("raw", F.split("captions", ";"))["confidence"])

by_example("caption_status", "captions string, icon string", "status string", [
    ("Прием заявок до 05.06", "red", "active"), ("Начало торгов 05.06;завершен", "green", "scheduled"), ("Торги завершены", "green", "closed"), ("", "icon-Green", "active"), (None, None, "unknown"), ("до окончания 2 дня;Начало торгов", None, "active"),
], lambda: classify.status_of_captions(F.split("captions", ";"), "icon"))

by_example("label_translation", "status string, category string", "status_title string, category_title string", [
    ("active", "land", "Активен", "Земельный участок"), ("closed", "car", "Завершен", "Автомобиль"), ("odd", "commercial_building_with_land", "odd", "Нежилое здание + ЗУ"), ("pending", "mystery", "Ожидается", "mystery"), ("unknown", "other", "Неизвестно", "Прочее"),
], lambda: classify.label("status", classify.STATUS_TITLES), lambda: classify.label("category", classify.CATEGORY_TITLES))

by_example("text_cleanup", "said string", "text string", [
    ("<p>Один  <b>два</b></p>", "Один два"), (" a \n b ", "a b"), (None, ""), ("x<br/>y", "x y"), ("5 < 6", "5 < 6"),
], lambda: text.clean("said"))

by_example("cyrillic_slugs", "said string", "slug string", [
    ("Щёлково, Московская обл.", "schelkovo-moskovskaya-obl"), ("Объект №5", "obekt-5"), ("Жуков Цех", "zhukov-ceh"), ("", "online"), (None, "online"), ("---", "online"),
], lambda: text.slug("said"))

by_example("composed_ids", "a string, b string, url string", "joined string, lot string, digest string", [
    ("12", " 3 ", "https://x.ru/lot/ab-1?y=2", "12_3", "ab-1", "202cb962ac59"), ("", None, "https://x.ru/lots/5", None, None, "202cb962ac59"), (None, "q", "/lot/77/", "q", "77", "202cb962ac59"),
], lambda: text.join_ids("a", "b"), lambda: text.lot_id_of_url("url"), lambda: F.substring(F.md5(F.lit("123")), 1, 12))

by_example("mojibake_repair", "said string", "text string", [
    ("Москва".encode().decode("latin-1"), "Москва"), ("plain", "plain"), ("Москва", "Москва"), (None, None), ("Ðx", "Ðx"),
], lambda: text.repair_mojibake("said"))

by_example("guid_test", "said string", "guid boolean", [
    ("8c5f1e0a-1b2c-4d3e-9f00-aabbccddeeff", True), (" 8C5F1E0A-1B2C-4D3E-9F00-AABBCCDDEEFF ", True), ("8c5f1e0a1b2c4d3e9f00aabbccddeeff", False), (None, False), ("г. Ярославль", False),
], lambda: text.is_guid("said"))

by_example("error_class", "said string", "transient boolean", [
    ("Read timed out", True), ("Connection reset", True), ("HTTP 503", True), ("429 Too Many Requests", True), ("404 not found", False), (None, False),
], lambda: text.is_transient_error("said"))

by_example("labelled_prices", "said string", "price double, rule string, confidence string", [
    ("Текущая цена: 1 250 000 руб.", 1250000.0, "price.current_price", "high"), ("Начальная цена 500000 ₽, текущая цена 450000 ₽", 450000.0, "price.current_price", "high"), ("Стартовая цена лота 99,5 руб", 99.5, "price.start_price", "high"),
    ("Цена продажи 77 рублей", 77.0, "price.sale_price", "medium"), ("Стоимость: 300 руб", 300.0, "price.generic_price", "medium"), ("Продаётся за 12 000 руб.", 12000.0, "price.single_currency_amount", "low"),
    ("Задаток 100 руб. Лот за 2000 руб. вместе с очень длинным описанием имущества", None, "price.not_found", "none"), ("100 руб. или 200 руб.", None, "price.ambiguous_currency_amounts", "none"), ("", None, "price.empty", "none"), (None, None, "price.empty", "none"), ("без цены", None, "price.not_found", "none"),
], lambda: extract.price("said")["value"], lambda: extract.price("said")["rule_id"], lambda: extract.price("said")["confidence"])

by_example("labelled_areas", "said string", "area double, rule string, building double, room double", [
    ("Нежилое здание общей площадью 540,5 кв.м", 540.5, "area.building_labeled", 540.5, None), ("Помещение площадью 30 м2", 30.0, "area.room_labeled", None, 30.0), ("Объект 75 кв. м", 75.0, "area.single_unlabeled", None, None),
    ("10 м2 и 20 м2", None, "area.ambiguous_multiple", None, None), ("", None, "area.empty", None, None), ("нет", None, "area.not_found", None, None), ("Жилой дом: 90 м²; участок 600 кв.м", 90.0, "area.building_labeled", 90.0, None),
], lambda: extract.area("said")["value"], lambda: extract.area("said")["rule_id"], lambda: extract.building_area("said"), lambda: extract.room_area("said"))

by_example("land_areas", "said string", "area double", [
    ("Земельный участок площадью 10 соток", 1000.0), ("земельного участка общей площадью 1,5 га", 15000.0), ("Земельный участок: 600 кв.м", 600.0), ("Площадь участка 12 сот.", 1200.0), ("Здание 50 м2", None), (None, None),
], lambda: extract.land_area("said"))

by_example("cadastral_numbers", "said string, more string", "found string, valid string", [
    ("Участки 76:23:010101:12 и 76:23:010101:12, 77:01:0001001:5", "7:2:0101:9", "76:23:010101:12|77:01:0001001:5", "7:2:0101:9"), ("нет", "bad", "", ""), (None, " 76:23: 010101:1 ", "", "76:23:010101:1"), ("76:23:010101:7", None, "76:23:010101:7", ""),
], lambda: _list(extract.cadastral_numbers("said")), lambda: _list(extract.cadastral_set(c("more"), F.lit(None).cast("array<string>"))))

by_example("addresses", "said string", "address string", [
    ("Адрес: г. Ярославль, ул. Свободы, д. 5 Кадастровый номер 76:23", "г. Ярославль, ул. Свободы, д. 5"), ("расположено по адресу: Московская обл., г. Клин, ул. Мира", "Московская обл., г. Клин, ул. Мира"), ("Адрес: коротко", None), (None, None),
], lambda: extract.address("said"))

by_example("building_facts", "said string", "floors int, built int, commissioned int, heritage boolean, legal string", [
    ("5 этажей, год постройки: 1975, год ввода: 1980. Объект культурного наследия", 5, 1975, 1980, True, None), ("Банкротство: здание 1700 г.", None, None, None, False, "банкротные торги"), ("введено в эксплуатацию в 2001, госимущество", None, None, 2001, False, "продажа гос. имущества"), (None, None, None, None, False, None),
], lambda: extract.floors("said"), lambda: extract.year_built("said", F.lit(2026)), lambda: extract.year_commissioned("said", F.lit(2026)), lambda: extract.is_heritage("said"), lambda: extract.legal_status("said"))

by_example("money_parse", "said string", "amount double", [
    ("1 250 000,50 руб.", 1250000.5), ("₽ 99", 99.0), ("цена 12.5", 12.5), ("даром", None), (None, None),
], lambda: money.parse_money("said"))

by_example("model_json_repair", "said string", "fixed string", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Ответ: {a: 1, b: [1, 2,],}', '{"a": 1, "b": [1, 2]}'), ("нет", None), (None, None), ('{"b": 2, "a": {"c": null}}', '{"a": {"c": null}, "b": 2}'),
], lambda: jsonwalk.repaired_object("said"))

by_example("date_formats", "said string", "moment timestamp_ntz, bare timestamp_ntz, shown string", [
    ("2026-05-15T10:00:00+03:00", "2026-05-15 07:00:00", "2026-05-15 10:00:00", "15.05.2026 07:00"), ("15.05.2026 10:30", "2026-05-15 10:30:00", "2026-05-15 10:30:00", "15.05.2026 10:30"), ("15.05.2026", "2026-05-15 00:00:00", "2026-05-15 00:00:00", "15.05.2026 00:00"),
    ("2026-05-15 08:09:10", "2026-05-15 08:09:10", "2026-05-15 08:09:10", "15.05.2026 08:09"), ("15.05.2026 10:00 (МСК)", None, None, None), ("скоро", None, None, None), (None, None, None, None),
], lambda: dates.parse("said"), lambda: dates.parse("said", keep_zone=False), lambda: dates.display(dates.parse("said")))

by_example("month_names", "said string", "moment timestamp_ntz, sort_key string", [
    ("5 мая 2026, 14:30", "2026-05-05 14:30:00", "0001-01-01"), ("31 декабря 2025", "2025-12-31 00:00:00", "0001-01-01"), ("01.02.2026", None, "2026-02-01"), (None, None, "0001-01-01"),
], lambda: dates.parse_month_name("said"), lambda: F.date_format(dates.sort_key("said"), "yyyy-MM-dd"))

by_example("discount_and_profit", "market double, price double", "discount double, profit double", [
    (200.0, 150.0, 25.0, 50.0), (100.0, 130.0, -30.0, -30.0), (0.0, 5.0, None, -5.0), (None, 5.0, None, None), (300.0, 200.0, 33.33, 100.0), (100.0, 0.0, None, 100.0),
], lambda: money.discount_percent("market", "price"), lambda: money.profit("market", "price"))

by_example("review_and_confidence", "confidence string, evidence int, a double, b double", "review boolean, weaker string, apart boolean", [
    ("low", 0, 100.0, 106.0, True, "low", True), ("high", 1, 100.0, 104.0, False, "medium", False), ("medium", 1, None, 1.0, False, "low", False), ("high", 3, 1.0, 1.0, False, "high", False), ("Низкая", 3, 0.0, 0.04, True, "Низкая", False),
], lambda: money.needs_review("confidence"), lambda: money.weaker_confidence(c("confidence"), c("evidence"), 3), lambda: money.prices_diverge("a", "b"))

by_example("cents", "amount double", "cents double, query_number string, comma_number string", [
    (1.005, 1.0, "1.005", "1,005"), (2.5, 2.5, "2.5", "2,5"), (100.0, 100.0, "100", "100"), (-3.456, -3.46, "-3.456", "-3,456"), (None, None, None, None),
], lambda: money.cents("amount").cast("double"), lambda: money.query_number("amount"), lambda: money.query_number("amount", comma=True))

_EVALUATION = "price double, low double, high double, confidence string, why string, links string, risk int, advice string, days string"
by_example("evaluation_validity", _EVALUATION, "problems string, said string", [
    (10.0, 5.0, 20.0, "high", "x", "https://a.ru/1", 3, "buy", "a month", "", f"{money.DISCLAIMER}\n\nbuy\n\nОжидаемый срок продажи: a month"),
    (30.0, 5.0, 20.0, "sure", "", "http://a.ru", 11, "buy", "soon", "range|confidence|explanation|links|risk", f"{money.DISCLAIMER}\n\nbuy\n\nОжидаемый срок продажи: soon"),
    (-1.0, -2.0, 20.0, "low", "x", "https://localhost/x", 1, "", "soon", "price|links|recommendation", f"{money.DISCLAIMER}\n\n\n\nОжидаемый срок продажи: soon"),
    (None, 1.0, 2.0, "low", "x", None, 1, "y", "z", "price|range", f"{money.DISCLAIMER}\n\ny\n\nОжидаемый срок продажи: z"),
], lambda: _list(money.evaluation_problems(c("price"), c("low"), c("high"), c("confidence"), c("why"), F.split("links", " "), c("risk"), c("advice"), c("days"))), lambda: money.advice_text(c("advice"), c("days")))

by_example("deep_json", "payload string", "found string, listed string, pathed string", [
    ('{"first":{"l1":{"key":"deep"}},"second":{"key":"shallow"}}', "deep", None, None), ('{"KEY":{"fullName":"named"}}', "named", None, None), ('{"a":[{"key":["x","y"]}],"list":["p","q"]}', "x, y", "p, q", None), ('{"a":{"b":"in"},"z":{"a":{"b":"not"}}}', None, None, "in"), ("broken", None, None, None), (None, None, None, None),
], lambda: jsonwalk.deep_pick("payload", "key"), lambda: jsonwalk.deep_pick("payload", "list"), lambda: jsonwalk.deep_pick("payload", "a.b"))

by_example("json_changes", "before string, after string", "changed string", [
    ('{"a":"1","b":"2"}', '{"a":"1","b":"3","c":"4"}', "b|c"), ("{}", "{}", ""), ('{"x":"1"}', "{}", "x"),
], lambda: _list(F.array_sort(F.map_keys(jsonwalk.map_difference(F.from_json("before", "map<string,string>"), F.from_json("after", "map<string,string>"))))))

by_example("image_addresses", "payload string", "images string", [
    ('{"photos":["//a.ru/1.jpg","https://b.ru/2.png","ftp://c"]}', "https://a.ru/1.jpg|https://b.ru/2.png"), ('{"lot":{"image":{"url":"https://x/1"},"text":"https://no"}}', "https://x/1"), ("{}", ""), (None, ""),
], lambda: _list(jsonwalk.image_urls("payload")))

by_example("real_estate_predicates", "category string, said string", "real boolean, sale boolean", [
    ("land", "что угодно", True, True), ("car", "квартира", False, False), (None, "Квартира на продажу", True, True), (None, "Право аренды здания: аренда", True, False), ("apartment", "1/2 доля в праве", True, False), ("other", "Станок", False, False), ("house", "Памятник архитектуры, объект культурного наследия", True, False),
], lambda: classify.is_real_estate("category", "said"), lambda: classify.is_sale_real_estate("category", "said"))

by_example("ended_lots", "archived boolean, closed string, status string, auction string", "ended boolean", [
    (True, None, "active", None, True), (None, "2026-01-01", "active", None, True), (False, None, "closed", None, True), (False, None, "active", "2025-01-01", True), (False, None, "active", "2027-01-01", False), (None, None, None, None, False),
], lambda: classify.ended(c("archived"), c("closed").cast("timestamp_ntz"), c("status"), c("auction").cast("timestamp_ntz"), F.lit("2026-06-01").cast("timestamp_ntz")))

by_example("region_inference", "name string, number string, address string", "region string", [
    ("  Тверская область ", "76:1:1:1", None, "Тверская область"), ("", "76:23:010101:1", "Москва", "Ярославская область"), (None, "5:1:1:1", None, "Республика Дагестан"), (None, None, "Россия, САМАРСКАЯ ОБЛАСТЬ, Тольятти", "Самарская область"), (None, "x", "где-то", "Регион не определён"),
], lambda: places.region_label("name", "number", "address"))

by_example("subject_match", "number string, address string", "matches boolean", [
    ("76:23:1:1", "", True), (None, "Ярославская область, Рыбинск", True), (None, "yaroslavskaya-oblast", True), ("77:1:1:1", "Москва", False), (None, None, False),
], lambda: places.in_subject("76", "Ярославская область", "number", "address"))

by_example("lookup_queries", "said string", "asked string", [
    ("76:23:010101:12", "76:23:010101:12"), ("ул. Свободы, 5", "Ярославль, ул. Свободы, 5"), ("г. Москва, Арбат", "г. Москва, Арбат"), ("", ""), (None, ""),
], lambda: places.lookup_query("said"))

by_example("geojson", "said string", "geometry string", [
    ('{"type":"Point","coordinates":[1.5,2],"crs":"x"}', '{"type":"Point","coordinates":[1.5,2]}'), ('{"type":"Point"}', None), ('{"coordinates":[1]}', None), (None, None),
], lambda: places.geojson("said"))

by_example("register_attributes", "props string, number string", "number_found string, address string, area string", [
    ('{"cad_num":"1:2","readableAddress":"ул. Мира","options":{"area":5}}', "9", "1:2", "ул. Мира", "5"), ('{"options":{"cn":"3:4","address":"x"},"address":""}', "9", "3:4", "x", None), ("{}", "9", "9", None, None),
], lambda: places.register_attributes("props", "number")["Кадастровый номер"], lambda: places.register_attributes("props", "number")["Адрес"], lambda: places.register_attributes("props", "number")["Площадь общая"])

by_example("unresolved_places", "address string, place string", "used string, lat double, to_check boolean", [
    ("a", "b", "a", None, True), ("", "b", "b", None, True), (None, None, "", None, True),
], lambda: places.unresolved("address", "place")["address_used"], lambda: places.unresolved("address", "place")["centroid_lat"], lambda: places.unresolved("address", "place")["needs_geo_check"])

by_example("ring_centres", "ring string", "lat double, lon double", [
    ("[[0,0],[4,0],[4,2],[0,2]]", 1.0, 2.0), ("[[5,7]]", 7.0, 5.0), ("[]", None, None),
], lambda: geo.ring_centre(F.from_json("ring", "array<array<double>>"))["lat"], lambda: geo.ring_centre(F.from_json("ring", "array<array<double>>"))["lon"])

by_example("feature_choice", "features string, number string", "chosen string", [
    ("a 76:1|b 76:2", "76:2", "b 76:2"), ("a|b", "c", "a"), (None, "c", None),
], lambda: review.fitting_feature(F.split("features", r"\|"), c("number")))

by_example("address_match_score", "asked string, named string", "score int", [
    ("Ярославль, улица Свободы", "Свободы улица, Ярославль, Россия", 3), ("Ярославская", "Ярославский", 1), ("Клин", "Тверь", 0),
], lambda: geo.candidate_score(c("asked"), c("named")))

by_example("address_candidates", "said string, region string", "asked string", [
    ("Ярославская область, м. р-н Угличский, с. п. Слободское, с. Ефремово, с земельным участком", None, "Ярославская область, Угличский муниципальный округ, село Ефремово|Ефремово, Угличский муниципальный округ, Ярославская область|Ефремово, Ярославская область"),
    ("Рязанская обл., г. Сасово, ул. Ленина, д. 7", None, "Рязанская область, город Сасово, улица Ленина, дом 7|7, улица Ленина, Сасово, Рязанская область|Сасово, Рязанская область"),
    ("п. Борок, Некоузский район...", "Ярославская область", "поселок Борок, Некоузский муниципальный округ, Ярославская область|Борок, Некоузский муниципальный округ, Ярославская область|Борок, Ярославская область"),
    ("", "Тверская область", ""), (None, None, ""),
], lambda: _list(geo.address_candidates("said", "region")))

by_example("client_sort_keys", "amount string, name string, moment string", "amount_key double, name_key string, moment_key string", [
    ("12.5", "Ёж", "15.05.2026 10:00", 12.5, "ёж", "2026-05-15"), (None, None, None, -1.0, "", "0001-01-01"), ("x", "ABC", "2026-05-15T08:00:00+03:00", -1.0, "abc", "2026-05-15"), ("0", "", "скоро", 0.0, "", "0001-01-01"),
], lambda: listing.sort_number("amount"), lambda: listing.sort_text("name"), lambda: F.date_format(dates.sort_key("moment"), "yyyy-MM-dd"))

by_example("paginators", "page string", "numbers string", [
    ("<div class='ty-pagination'><a href='?page=2'>2</a><a href='?a=1&page=11'>11</a><a href='?page=2'>next</a></div>", "2|11"), ("<a href='?page=5'>5</a>", ""), (None, ""),
], lambda: _list(F.transform(cards.page_numbers_of("page"), lambda n: n.cast("string"))))

_ADVICE = f"{money.DISCLAIMER}\n\nbuy\n\n{money.REVIEW_NOTE}\n\nОжидаемый срок продажи: soon"
by_example("model_assessments", "market string, risk string, sparse boolean", "price double, confidence string, explanation string, advice string, problems string", [
    ('{"market_price": 10.005, "min_price": 5, "max_price": 20, "confidence": "high", "explanation": "x", "links": ["https://a.ru/1"]}', '{"risk_score": 3, "recommendation": "buy", "time_to_sell": "soon"}', False, 10.01, "high", "x", _ADVICE, ""),
    ('```json\n{market_price: 10, "min_price": 5, "max_price": 20, "confidence": "high", "explanation": "x",}\n```', '{"risk_score": 3, "recommendation": "buy", "time_to_sell": "soon"}', False, 10.0, "low", f"{money.SPARSE_NOTE} x", _ADVICE, ""),
    ('{"market_price": 30, "min_price": 5, "max_price": 20, "confidence": "sure", "explanation": "x", "links": ["http://a"]}', '{"risk_score": 30, "recommendation": "buy"}', True, 30.0, "low", f"{money.SPARSE_NOTE} x", None, "range|confidence|links|risk|time_to_sell"),
    ("none", None, None, None, "low", None, None, "price|range|confidence|explanation|risk|recommendation|time_to_sell"),
], *[lambda n=n: money.assessment(jsonwalk.repaired_object("market"), c("risk"), c("sparse"))[n] for n in ("market_price", "confidence", "explanation", "advice")], lambda: _list(money.assessment(jsonwalk.repaired_object("market"), c("risk"), c("sparse"))["problems"]))

by_example("source_backfill", "source string", "system string, region string", [
    ("town:yaroslavl", "towns", "yaroslavl"), ("town:", "towns", None), ("other", "other", None), (None, None, None),
], lambda: links.source_parts("source", "town:", "towns")["system"], lambda: links.source_parts("source", "town:", "towns")["region"])

by_example("kept_statuses", "raw string, existing string", "status string, kept boolean", [
    ("завершены", "active", "closed", False), ("?", "active", "active", True), ("?", "unknown", "unknown", False), (None, None, "unknown", False), ("", "", "unknown", False),
], *[lambda f=f: f(classify.kept_status(classify.status_decision("raw", F.array().cast("array<string>")), "existing")) for f in (lambda s: s["final_status"], lambda s: F.endswith(s["trace_reason"], F.lit("preserved.")))])

_FOUND = "<article>76:01:000001:{n}0 <a href='/lot/1'>x</a></article><article>№ 76:01:000001:{n} <a href='/news/5'>n</a><a href='/lot/{n}/#top'>x</a></article>"
by_example("cross_site_lookup", "html string, number string", "url string", [
    (_FOUND.format(n=7), "76:01:000001:7", "/lot/7/"), (_FOUND.format(n=8), " 76:01: 000001:8", "/lot/8/"), (_FOUND.format(n=7), "76:01:000001:9", None), ("<article>76:1:1:1</article>", "76:1:1:1", None), (None, "76:1:1:1", None), (_FOUND.format(n=7), None, None),
], lambda: cards.found_by_number(c("html"), c("number")))

by_example("lot_pages", "html string", "images string, links int, number string", [
    ("""<div id="lot-gallery" data-gallery='[{"url":"/1.png"},{"src":"/2.png"},{"url":"/1.png"},3]'></div><a href="https://x/lots/lot/1">x</a> РАД: 22000012-2024-0001-3""", "/1.png|/2.png", 1, "22000012-2024-0001-3"),
    ("<div id='lot-gallery' data-gallery='broken'></div>", "", 0, None), (None, "", 0, None),
], lambda: _list(cards.lot_page_of("html")["images"]), lambda: F.size(cards.lot_page_of("html")["links"]), lambda: cards.lot_page_of("html")["procedure_number"])


@pytest.mark.parametrize("name", CASES)
def test_example(spark, name):
    inputs, results, examples, columns = CASES[name]
    given, wanted = _fields(inputs), _fields(results)
    said = ", ".join(f"{n} {t}" for n, t in given)
    want = ", ".join(f"want_{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in wanted)
    rows = spark.createDataFrame(examples, f"{said}, {want}")
    made = [c() if callable(c) else c for c in columns]
    got = rows.select(*[m.cast(t).alias(n) for m, (n, t) in zip(made, wanted, strict=True)], *[F.col(f"want_{n}").cast(t).alias(f"want_{n}") for n, t in wanted]).collect()
    assert [tuple(r[n] for n, _ in wanted) for r in got] == [tuple(r[f"want_{n}"] for n, _ in wanted) for r in got]
    assert len(got) == len(examples)
