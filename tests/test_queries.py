"""Every query with SQL gives the same rows as DuckDB; the others are run."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from lotwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert df.columns
        return
    res = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in res.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    assert got == want


def test_set_difference_sees_every_order(spark, tmp_path):
    """Any order takes its customer out, whatever its status and price; a key that is null is one key."""
    spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (5,), (5,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, "F", 150000.0), (2, "O", 150000.0), (3, "F", 99.0), (None, "P", 5.0), (9, "F", 5.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.c_custkey for r in catalogue.QUERIES["set_difference"](spark, str(tmp_path)).collect()) == [4, 5]
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(c.execute(catalogue.SQL["set_difference"]).fetchall()) == [(4,), (5,)]
