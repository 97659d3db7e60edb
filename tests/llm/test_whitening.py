import math
from fractions import Fraction

import numpy as np
import pytest

from lotwright.llm import whitening

DDL = "vec_id long, embedding array<float>, label int"


def expected(rows, k=4):
    """By whole numbers, fractions and numpy's solver on the full covariance."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    total = float(Fraction(sum((n * x[j] - sums[j]) ** 2 for x in distinct for j in range(d)), n**3))
    out = {}
    for i, x in kept:
        for c in range(min(k, d)):
            v = vectors[:, -1 - c]
            w = float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)], v) / math.sqrt(values[-1 - c]))
            out.setdefault((i, c + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w, float(values[-1 - c]) / total))
    return out


def compare(got, want):
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-8
        if abs(w) > 1e-3:
            sign.setdefault(r.component, math.copysign(1, w) * math.copysign(1, r.whitened))
        assert abs(r.whitened * sign.get(r.component, 1) - w) < 1e-7 * max(1, abs(w)) or abs(w) <= 1e-3


def test_driver_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = whitening.op13_embedding_whitening(spark, sf).collect()
    compare(got, expected(rows))
    assert all(r.identity_error == got[0].identity_error for r in got)


@pytest.mark.parametrize("d", [1, 3, 7, 130])
def test_any_number_of_dimensions(spark, d):
    rng = np.random.default_rng(d)
    drawn = (rng.normal(size=(400, d)) * np.linspace(3, 0.2, d) + 5).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(drawn)] + [(1000 + i, drawn[0], 1) for i in range(300)]  # copies count once
    compare(whitening.whiten(spark.createDataFrame(rows, DDL)).withColumnRenamed("id", "vec_id").collect(), expected(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [0.5, -1.25], 0), (None, [3.0, 0.001], 0), (4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [-inf, 1.0], 0), (9, [], 0), (1, [1.0, 2.0], 0), (10, [-0.0, -0.001], 0)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], DDL + ", x string, n int")
    got = whitening.whiten(df).withColumnRenamed("id", "vec_id").collect()
    compare(got, expected([r for r in rows if r[0] != 9]))
    assert {r.vec_id for r in got} == {1, 2, None, 10}


def test_no_variance_and_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], DDL)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], DDL)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], DDL)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(9)], DDL)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9


def test_lengths_that_differ_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], DDL))


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [1e13 * i, 1.0], 0) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert got and any(r.deviation is None for r in got) and abs(got[0].explained - 1) < 1e-9
