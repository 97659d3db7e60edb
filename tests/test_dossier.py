import datetime as dt

from pyspark.sql import functions as F

from lotwright.operators import dossier


def test_dossiers_are_whole(spark):
    lots = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "lot int, title string")
    cards = spark.createDataFrame([(10, 1, "x"), (9, 1, "y"), (20, 2, "z"), (99, 7, "other lot")], "card int, lot int, source string")
    documents = spark.createDataFrame([(10, "d2", 2), (10, "d1", 1), (20, "d3", 1), (55, "no card", 1)], "card int, doc string, version int")
    got = {r.lot: [(c.card, c.source, [(d.version, d.doc) for d in c.documents]) for c in r.cards] for r in dossier.dossiers(lots, cards, documents, "lot", "card", ["version"]).collect()}
    assert got == {1: [(9, "y", []), (10, "x", [(1, "d1"), (2, "d2")])], 2: [(20, "z", [(1, "d3")])], 3: []}


def test_procedures_by_number_and_source(spark):
    cards = spark.createDataFrame([("n1", "Torgi.RU", 5), ("n1", "torgi.ru", 4), ("n1", "other", 1), ("n2", None, 2)], "number string, source string, id int")
    asked = spark.createDataFrame([("n1", "TORGI%"), ("n1", "x"), ("n2", "%"), (None, "%")], "number string, source string")
    assert sorted(((r.number, r.source, r.id) for r in dossier.first_by_procedure(asked, cards, "number", "source", "id").collect()), key=str) == sorted([("n1", "TORGI%", 4), ("n1", "x", None), ("n2", "%", None), (None, "%", None)], key=str)


def test_contradictions(spark):
    links = spark.createDataFrame([(1, 10, "ok"), (2, 10, "another"), (3, 10, "lot lacks"), (1, 77, "asset lacks"), (4, 11, "lot names none")], "lot int, asset int, what string")
    lots = spark.createDataFrame([(1, 10), (2, 11), (4, None)], "lot int, _asset int")
    assets = spark.createDataFrame([(10,), (11,)], "asset int")
    got = {r.what: r.reason for r in dossier.contradictions(links, lots, assets, "lot", "asset").collect()}
    assert got == {"another": "another asset", "lot lacks": "no lot", "asset lacks": "no asset"}


def test_cached_cards(spark):
    rows = [(1, None, "Тверская область", "{}", "Дом", None, None, 100.0), (2, True, "Тверь", "{}", "Дом", "", 50.0, 1.0), (3, False, None, '{"region_name": "г. ТВЕРЬ"}', None, "дом 5%", 70.0, 1.0), (4, False, "Клин", "{}", "дом", "", None, None)]
    df = spark.createDataFrame(rows, "id int, is_archived boolean, region_name string, raw string, title string, address string, current_price double, start_price double")
    ids = lambda **k: sorted(r.id for r in dossier.cached(df, "raw", **k).collect())
    assert ids() == [1, 3, 4] and ids(region="ТВЕР") == [1, 3] and ids(search="5%") == [3] and ids(low=60, high=80) == [3] and ids(low=60) == [1, 3]


def test_archiving_keeps_what_is_known(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 1)
    rows = [(1, "closed", None, None, None), (2, "closed", False, old, None), (3, "closed", True, None, None), (4, "active", None, None, None), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, auction_status string, is_archived boolean, archived_at timestamp_ntz, closed_at timestamp_ntz")
    got = {r.id: (r.is_archived, r.archived_at, r.closed_at) for r in dossier.archived(df, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {1: (True, now, now), 2: (True, old, now), 3: (True, None, None), 4: (False, None, None), 5: (False, None, None)}


def test_counters_and_overview(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", False)], "source string, bad boolean")
    assert {r.source: r.state for r in dossier.source_counters(df, "source", F.col("bad")).collect()} == {"a": "partial", "b": "failed", "c": "success"}
    lots = spark.createDataFrame([("active", 1.0), ("closed", None)], "auction_status string, rating double")
    assert tuple(dossier.overview(lots, spark.createDataFrame([], "last_success_at timestamp_ntz")).first()) == (2, 1, 1, None)
