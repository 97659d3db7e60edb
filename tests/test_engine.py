import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotwright.engine import Engine
from lotwright.operators import review


@pytest.fixture(scope="module")
def engine(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "Склад", "x" * 300, "улица Мира", "land", "active", "76", "Ярославская область", 0.0, 500.0, 10.0, 50.0, 3, False, day, 57.6, 39.9),
        (2, "Дом", "", "площадь", "house", "closed", "77", "г. Москва", 5.0, 700.0, None, None, None, False, day, 55.7, 37.6),
        (3, "Цех", "", "", "land", "active", "76", "Ярославская область", 5.0, None, None, 90.0, 1, False, day, None, None),
        (4, "Дача", "", "", "house", "active", "76", "Ярославская область", 5.0, 100.0, 30.0, 60.0, 2, True, day, 0.0, 175.0),
        (5, "Склад два", "", "", "land", "active", "76", "Ярославская область", 5.0, 100.0, 20.0, 60.0, 2, None, day, 0.0, -175.0),
    ]
    schema = "id long, title string, description string, address string, category string, status string, region_code string, region_name string, start_price double, current_price double, discount_percent double, rating double, risk_score int, archived boolean, published_at timestamp, lat double, lon double"
    watch = spark.createDataFrame([("u", 1), ("u", 2), ("u", 2), ("v", 5)], "user_id string, lot_id long")
    versions = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2), (1, 3, "b", 2)], "lot_id long, version int, content string, size long")
    return Engine(lots=spark.createDataFrame(rows, schema), watchlist=watch, versions=versions)


def ids(df):
    return [r.id for r in df.collect()]


def test_listing(engine):
    assert ids(engine.listing()) == [5, 1, 2]  # no archived lot, none without a price
    assert ids(engine.listing(sort="price_desc")) == [2, 1, 5] and ids(engine.listing(page=2, size=2)) == [2]
    assert ids(engine.listing(term="СКЛАД", region="Ярославская обл".replace("обл", "область"))) == [5, 1]
    assert ids(engine.listing(region="77")) == [2] and ids(engine.listing(risk=(1, 2))) == [5]
    first = engine.listing(categories=["land"], price=(400, 600)).first()
    assert first.description == "x" * 200 + "..." and first.start_price is None
    with pytest.raises(ValueError):
        engine.listing(price=(5, 1))


def test_maps(engine):
    assert ids(engine.map_lots(170, -10, -170, 10)) == [5]
    rows = engine.map_lots(-180, -90, 180, 90, limit=2).collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].truncated
    assert ids(engine.nearest(57.6, 39.9, 1)) == [1]


def test_other_questions(engine):
    assert ids(engine.watched("u")) == [1]
    assert [r.changed for r in engine.document_changes(1).orderBy("version").collect()] == [True, False]
    assert {r.region_code: (r.total, r.active, r.rated, r.avg_discount) for r in engine.stats().collect()}["76"] == (4, 4, 4, 20.0)
    assert [r.label for r in engine.regions().collect()] == ["76 — Ярославская область", "77 — г. Москва"]
    assert {r.scenario for r in engine.max_bid(2, months=6, bid=100.0).collect()} == {"pessimistic", "base", "optimistic"}
    with pytest.raises(AttributeError):
        engine.nothing


def test_review(spark):
    ties = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "id long, primary long")
    after = review.merged(ties, 1, 2)
    assert {tuple(r) for r in after.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert {tuple(r) for r in review.split(after, 2).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}
    chain = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, primary long")
    assert {r.primary for r in review.compressed(chain).collect()} == {1}
    df = spark.createDataFrame([("1", ["a", "b 1"]), ("9", ["a", "b 1"]), ("9", [])], "i string, f array<string>")
    assert [r[0] for r in df.select(review.fitting_feature(F.col("f"), F.col("i"))).collect()] == ["b 1", "a", None]
    scores = spark.createDataFrame([("q", 3, 0.1, "x"), ("q", 2, 0.8, "y"), ("r", 1, 0.9, "z")], "k string, score int, importance double, name string")
    assert [r.name for r in review.confirmed(scores, "k", "score", "importance").collect()] == ["x"]
    two = spark.createDataFrame([(1, None)], "a int, b string")
    assert two.select(review.valuation_key("a", "b") == review.valuation_key("b", "a")).first()[0]
