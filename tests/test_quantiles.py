import math
import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import quantiles


@pytest.mark.parametrize("error", [None, 0.0])
def test_nearest_ranks(spark, monkeypatch, error):
    if error is not None:  # bounds so tight that most ranks miss them: they are counted in full
        monkeypatch.setattr(quantiles, "ERROR", error)
    rnd = random.Random(3)
    rows = [(g, rnd.choice([float(rnd.randint(0, 50)), rnd.gauss(100, 30), 7.0])) for g in ("a", "b") for _ in range(4000)] + [("c", 1.0), ("d", None), (None, 2.0), ("e", 5.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): r.value for r in quantiles.nearest_ranks(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for g in ("a", "b", "c", "e"):
        held = sorted(v for x, v in rows if x == g)
        for share in (0.0, 0.5, 0.95, 1.0):
            assert got[g, share] == held[max(math.ceil(share * len(held)), 1) - 1], (g, share)
    assert ("d", 0.5) not in got


def test_sketches_add_up(spark):
    df = spark.range(50_000).select((F.col("id") % 24).alias("hour"), F.lit("x").alias("day"), F.col("id").cast("double").alias("v"))
    day = quantiles.merged(quantiles.sketches(df, ["day", "hour"], "v"), ["day"])
    r = day.select("n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q"), F.length("sketch").alias("size")).first()
    assert r.n == 50_000 and abs(r.q - 25_000) < 50_000 * 2 * quantiles.ERROR and r.size < 40_000
    assert quantiles.nearest_ranks(df, ["day"], "v", [0.95], day).first().value == 47_499.0


def test_histogram(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y")], "g string, s string")
    assert {r.g: r.histogram for r in quantiles.histogram(df, ["g"], "s").collect()} == {"a": {"x": 2, "unknown": 1}, "b": {"y": 1}}
