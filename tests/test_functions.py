"""Scalar cases of the expressions, by table: input, expected."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from lotwright.functions import classify, dates, extract, geo, jsonwalk, money, regions, text


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over one row of texts a, b, c."""

    def of(expression, *args, kind="string"):
        names = "abcdefgh"[: len(args)]
        df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {kind}" for n in names)) if args else spark.range(1)
        return df.select(expression.alias("x")).first().x

    return of


def test_categories(value):
    for title, want in (("Квартира 65 кв.м", "apartment"), ("Грузовой автомобиль", "car"), ("Право требования долга", "receivable"), ("Земельный участок", "land"), ("Склад и земельный участок", "commercial_building_with_land"), ("Гараж", "parking"), ("", "other"), (None, "other")):
        assert value(classify.category("a", F.lit(None)), title) == want
    assert value(classify.category_of_source("a", {"2": "land"}, "b", "c", F.lit("")), "2", "", "") == "land"
    assert value(classify.category_of_source("a", {"2": "land"}, "b", "c", F.lit("")), "7", "Недвижимость", "") == "real_estate"


def test_statuses(value):
    for raw, want in (("Опубликовано", "active"), ("Приём заявок", "scheduled"), ("Завершено", "closed"), ("Несостоявшийся", "closed"), (" Иное ", "Иное"), ("", "unknown"), (None, "unknown")):
        assert value(classify.status("a"), raw) == want
    assert value(classify.catalogue_status("a"), "APPLICATIONS_SUBMISSION") == "active"
    assert value(classify.status_decision("a", F.array(F.lit("до окончания 2 дня"))), "").final_status == "active"
    assert value(classify.label("a", classify.STATUS_LABELS), "closed") == "Завершён" and value(classify.label("a", classify.STATUS_LABELS), "x") == "x"


def test_sale_predicate(value):
    cases = (("16/131 доля в праве на нежилое помещение", False), ("ДОЛЯ здания", False), ("Объект культурного наследия, здание", False), ("Нежилое помещение, г. Сасово", True), ("Право аренды здания", False), ("Автомобиль", False))
    for said, want in cases:
        assert value(classify.is_sale_real_estate(F.lit(None).cast("string"), "a"), said) is want, said


def test_money(value):
    assert value(money.parse_money("a"), "Цена 1 250 000,50 руб.") == 1250000.5
    assert value(money.parse_money("a"), "нет") is None
    assert value(money.discount_percent("a", "b"), 10e6, 7.5e6, kind="double") == 25.0
    assert value(money.profit("a", "b"), 10e6, 7.5e6, kind="double") == 2_500_000
    none = F.lit(None).cast("string")
    assert value(money.rating(F.lit(25.0), F.lit(4), F.lit("active"), F.lit("low"), F.lit(""), none, none, F.lit(None).cast("double"))) == 4.75
    assert value(money.rating(F.lit(25.0), F.lit(4), F.lit("closed"), F.lit("low"), F.lit(""), none, none, F.lit(1.0))) == 0
    assert value(money.needs_review("a"), "Низкая") and not value(money.needs_review("a"), "высокая")
    assert value(money.prices_match("a", "b"), 1000.0, 1000.9, kind="double") and not value(money.prices_match("a", "b"), 1000.0, 1002.0, kind="double")
    assert value(money.prices_diverge("a", "b"), 100.0, 106.0, kind="double")
    assert [value(money.backoff_seconds("a", 300, 3600), n, kind="int") for n in (1, 2, 5)] == [300, 600, 3600]


def test_bid_scenarios(spark):
    given = dict(sale=10e6, repair=5e5, legal=1e5, holding=5e4, months=6, taxes=1e5, commission=2, target=1.5e6, reserve=3e5, capital=12, bid=6e6)
    rows = {r.scenario: r for r in money.bid_scenarios(spark.range(1), **{k: F.lit(v) for k, v in given.items()}).collect()}
    want = {"pessimistic": (9000000, 5390697.67, 845000, 10.36, 17.09, 8155000, 7.5), "base": (10000000, 6603773.58, 2140000, 27.23, 61.87, 7860000, 6), "optimistic": (10500000, 7251908.40, 2812000, 36.58, 117.99, 7688000, 4.8)}
    for name, values in want.items():
        assert tuple(rows[name])[2:] == pytest.approx(values, abs=0.02)
    assert money.bid_scenarios(spark.range(1), **{k: F.lit(v) for k, v in (given | {"months": 0}).items()}).count() == 0


def test_price_and_area_provenance(spark, value):
    p = value(extract.price("a"), "Начальная цена 2 400 000 000 руб. площадь 500 кв.м, задаток 100 руб.")
    assert (p.value, p.rule_id, p.confidence) == (2400000000.0, "price.start_price", "high")
    p = value(extract.price("a"), "100 руб. или 200 руб.")
    assert p.value is None and p.rule_id == "price.ambiguous_currency_amounts"
    a = value(extract.area("a"), "Земля 10 000 м2, строение 500 м2.")
    assert a.value is None and a.rule_id == "area.ambiguous_multiple"
    a = value(extract.area("a"), "Нежилое здание общей площадью 10215.5 кв.м, участок 25000 кв.м")
    assert (a.value, a.rule_id, a.confidence) == (10215.5, "area.building_labeled", "high")
    assert value(extract.area("a"), None).rule_id == "area.empty"


def test_facts_from_text(value):
    assert value(extract.address("a"), "Нежилые помещения, адрес: Москва, Долгоруковская ул., д. 4А, этажи -2, 1") == "Москва, Долгоруковская ул., д. 4А"
    assert value(extract.cadastral_numbers("a"), "участок 76:22:010305:18 и здание 76:22:010305:530, 76:22:010305:18") == ["76:22:010305:18", "76:22:010305:530"]
    assert value(extract.clean_cadastral("a"), "76 : 22:010305: 18") == "76:22:010305:18" and value(extract.clean_cadastral("a"), "1:2") is None
    assert value(extract.land_area("a"), "Земельный участок: 19.18 сотки") == pytest.approx(1918)
    assert value(extract.land_area("a"), "земельный участок площадью 2 га") == 20000
    assert value(extract.floors("a"), "дом, 5 этажей") == 5
    assert value(extract.year_built("a", F.lit(2026)), "год постройки: 1987") == 1987 and value(extract.year_built("a", F.lit(2026)), "год постройки: 1700") is None
    assert value(extract.year_commissioned("a", F.lit(2026)), "введен в эксплуатацию в 2001") == 2001
    assert value(extract.legal_status("a"), "Торги: конкурсный управляющий") == "банкротные торги"
    assert value(extract.canonical_key(*map(F.col, "abcdef")), "76:22 :1", "", None, None, "s", "1") == "cadastral:76:22:1"
    assert value(extract.canonical_key(*map(F.col, "abcdef")), " ", "", "c", "p", "s", "1") == "case:c:p"
    assert value(extract.canonical_key(*map(F.col, "abcdef")), None, None, "c", "", "s", "1") == "source:s:1"


def test_regions(spark):
    df = spark.createDataFrame([("Ярославская обл.", "76"), ("г Москва", "77"), ("Респ Татарстан", "16"), ("7", "07"), ("Югра", "86"), ("нигде", None)], "a string, want string")
    assert all(r.region_code == r.want for r in regions.with_region(df, "a").collect())
    assert len(regions.directory()) == 88 or len(regions.directory()) == 89


def test_text(value):
    assert value(text.clean("a"), " <b>A</b>  B\n c ") == "A B c"
    assert value(text.slug("a"), "Ярославская область") == "yaroslavskaya-oblast" and value(text.slug("a"), None) == "online"
    assert value(text.containment("a", "b"), "Ярославская область, улица Мира 12", "улица Мира") == 1.0
    assert value(text.containment("a", "b"), "", "x y") == 0.0
    assert value(text.contains_all_terms("a", "центр север"), "Центр, север города") and not value(text.contains_all_terms("a", "цент"), "центр")
    assert value(text.lot_id_of_url("a"), "https://x/lot/12_3?a=1") == "12_3"
    assert value(text.repair_mojibake("a"), "Дом".encode().decode("latin-1")) == "Дом"
    assert value(text.shorten("a"), "x" * 201) == "x" * 200 + "..."
    assert value(text.is_guid("a"), "123e4567-e89b-12d3-a456-426614174000") and not value(text.is_guid("a"), "x")


def test_dates(value):
    at = dt.datetime(2030, 1, 2, 12, 30)
    for said in ("2030-01-02 12:30:00", "02.01.2030 12:30", "2030-01-02T12:30:00Z", "2030-01-02T15:30:00+03:00"):
        assert value(dates.parse("a"), said) == at
    assert value(dates.parse("a"), "15.05.2026 10:00 (МСК)") is None
    assert value(dates.parse("a", False), "2030-01-02T12:30:00+03:00") == at
    assert value(dates.parse("a"), "x") is None and value(dates.sort_key("a"), "x") == dt.datetime(1, 1, 1)
    assert value(dates.parse_month_name("a"), "2 января 2030, 12:30") == at
    assert value(dates.display("a"), at, kind="timestamp_ntz") == "02.01.2030 12:30"


def test_geo(value):
    assert value(geo.haversine_km(*map(F.col, "abcd")), 0.0, 0.0, 0.0, 1.0, kind="double") == pytest.approx(math.pi * 6371 / 180)
    r = value(geo.mercator_to_degrees(F.col("a"), F.col("b")), 4439000.0, 7881000.0, kind="double")
    assert r.lon == pytest.approx(39.876, abs=1e-2) and r.lat == pytest.approx(57.587, abs=1e-2)
    box = lambda w, e: value(geo.in_box(F.col("a"), F.col("b"), w, -10, e, 10), 175.0, 0.0, kind="double")
    assert box(170, -170) and not box(-170, 170)
    first = value(geo.address_candidates("a"), "Ярославская область, м. р-н Угличский, с. п. Слободское, с. Ефремово, с земельным участком")
    assert first[0] == "Ярославская область, Угличский муниципальный округ, село Ефремово" and len(first) <= 4
    assert geo.padded_box(0, 0, 10, 10) == (-1.5, -1.5, 11.5, 11.5)
    assert geo.padded_box(0, 0, 0.01, 0.0123456, 16) == (-0.02, -0.02, 0.03, 0.0323) and geo.padded_box(-179, -89, 179, 89, 10) == (-180.0, -90.0, 180.0, 90.0)


def test_json(value):
    payload = json.dumps({"photos": [{"url": "https://a/1"}, {"thumbnail": "//a/2"}, {"image_url": "javascript:x"}, {"photo_url": "file:x"}, {"url": "https://a/1"}]})
    assert value(jsonwalk.image_urls("a"), payload) == ["https://a/1", "https://a/2"]
    assert value(jsonwalk.first_non_empty("a", "x", "y", "z"), '{"x": "", "y": [], "z": 3}') == "3"
    assert value(jsonwalk.deep_pick("a", "Price.value"), '{"price": {"Value": "7"}}') == "7"
    assert value(jsonwalk.deep_pick("a", "Price.value"), '{"q": [{"price": {"Value": "7"}}]}') is None  # a path begins at the top
    assert json.loads(value(jsonwalk.repaired_object("a"), "```json\n{a: 1, \"b\": [2,],}\n```")) == {"a": 1, "b": [2]}
    diff = value(jsonwalk.map_difference(F.create_map(F.lit("pages"), F.lit("1")), F.create_map(F.lit("pages"), F.lit("2"))))
    assert {k: tuple(v) for k, v in diff.items()} == {"pages": ("1", "2")}


def test_an_amount_alone_is_read_whole(spark):
    from lotwright.functions import extract

    said = ["Продаётся за 40437.92 руб.", "за 1234567 руб", "за 12 345,60 ₽", "за 1.5 руб. и 77 кг"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r.v for r in df.select("i", extract.price("s")["value"].alias("v")).orderBy("i").collect()] == [40437.92, 1234567.0, 12345.6, 1.5]


def test_centre_of_any_nesting(spark):
    from lotwright.functions import geo

    shapes = ['{"type":"Point","coordinates":[1.5,-2e0]}', '{"coordinates":[[0,0],[4,2]]}', '{"coordinates":[[[[0,0,9],[4, 0,9]]],[[[2,6,9]]]]}', '{"coordinates":[]}', "{}", "broken", None]
    df = spark.createDataFrame(list(enumerate(shapes)), "i int, s string")
    got = [r.p and tuple(r.p) for r in df.select("i", geo.shape_centre("s").alias("p")).orderBy("i").collect()]
    assert got == [(-2.0, 1.5), (1.0, 2.0), (2.0, 2.0), None, None, None, None]
