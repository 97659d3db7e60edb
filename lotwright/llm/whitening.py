"""Whitening of embeddings by the singular values of their centred rows.

Entries become whole numbers (256ths, rounded down), so sums, counts and deviations are exact. Each distinct vector
counts once. MLlib's RowMatrix.computeSVD of the centred rows, which Spark keeps distributed, gives the components;
with n rows, a singular value s is a variance of s**2 / n. The total variance does not come from it: it is the sum of
the exact deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 4
#: Whole numbers to one of the vectors' units.
SCALE = 256
#: Components with a smaller share of the first one's variance are noise of rounding, and are left out.
LEAST_SHARE = 1e-14


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (id, x) of the vectors without null, NaN or infinite entries: x = floor(scale * entry) as longs."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    x = F.transform(v, lambda c: F.floor(c * float(scale)).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(fine & (F.size(v) > 0), F.lit(False)).alias("_fine")).where("_fine").select("id", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            sums, n = x.sum(axis=0) + (0 if sums is None else sums), n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["n", "sums"])


class Whitening:
    """What a fit gives: n, the exact sums of all dimensions, components (a row each), their variances, and the total variance."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, variances: np.ndarray):
        self.n, self.sums, self.components, self.variances = n, sums, components, variances
        self.total, self.identity_error = float("nan"), float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, from whole numbers: the mean's own rounding would else be in every row."""
        return self._deviations(x).astype(np.float64) / self.n

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in 64 bits where they are enough, else in numbers of any length."""
        most = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n, max(map(abs, self.sums.tolist()), default=0))
        wide = most * most * 4 * max(1, x.shape[1]) >= 2**63
        return (x.astype(object) if wide else x) * self.n - (self.sums.astype(object) if wide else self.sums)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - sums)**2 over dimensions, exact."""
        d = self._deviations(x)
        return (d * d).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)


def distinct_vectors(whole: DataFrame) -> DataFrame:
    """Each vector once, staged: the fit reads it several times."""
    return common.stage(whole.select("x").distinct(), "vectors")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to a table of distinct_vectors; None if it is empty.

    The driver gets a sum for each dimension, the components and, inside computeSVD, the dimensions' Gram matrix: their
    number bounds all three. Vectors of different lengths raise ValueError. Components without variance are left out.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    widths = distinct.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if widths.least is None:
        return None
    if widths.least != widths.most:
        raise ValueError(f"vectors of {widths.least} and of {widths.most} entries")
    parts = distinct.mapInArrow(_partial_sums, "n long, sums array<long>")
    added = parts.select("n", F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).orderBy("at").collect()
    n, sums = added[0].n, np.array([r.sum for r in added], np.int64)
    shape = Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays([common.lists(shape.centred(x).ravel(), np.full(len(x), x.shape[1]), pa.float64())], ["v"])

    rows = distinct.mapInArrow(centre, "v array<double>").select(array_to_vector("v").alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, len(sums))
    # More than half of the dimensions: computeSVD then solves the Gram matrix of one pass in full, to double precision.
    found = matrix.computeSVD(max(min(components, len(sums)), len(sums) // 2 + 1), computeU=False)
    values = found.s.toArray()[:components]
    variances = values**2 / n
    kept = variances > LEAST_SHARE * (variances[0] if len(variances) else 0)
    return Whitening(n, sums, found.V.toArray().T[:components][: len(kept)][kept], variances[kept])


def measured(distinct: DataFrame, model: Whitening) -> Whitening:
    """The model with its total variance, from exact deviations, and identity_error: how far the covariance of the whitened
    vectors is from the identity at most. One pass; each task gives a row of the components' number squared."""
    k = len(model.variances)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total, deviation = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                w = model.whitened(x)
                products, total, deviation = products + w.T @ w, total + w.sum(axis=0), deviation + sum(model.deviation(x))
        yield pa.RecordBatch.from_arrays([pa.array([products.ravel().tolist()], pa.list_(pa.float64())), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([str(deviation)])], ["products", "total", "deviation"])

    parts = common.stage(distinct.mapInArrow(sums, "products array<double>, total array<double>, deviation string"), "moments")
    added = {
        name: [r.value for r in parts.select(F.posexplode(name).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()]
        for name in ("products", "total")
    }
    # Exact: deviations have any number of digits, so they are added up by pieces of fifteen.
    pieces = parts.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.substring(F.reverse(F.lpad("deviation", 150, "0")), i * 15 + 1, 15))).alias("at", "piece"))
    pieces = pieces.groupBy("at").agg(F.sum(F.reverse("piece").cast("decimal(38,0)")).alias("sum")).collect()
    deviation = sum(int(r.sum) * 10 ** (15 * r.at) for r in pieces)
    common.drop(parts)
    mean = np.array(added["total"]) / model.n
    covariance = np.array(added["products"]).reshape(k, k) / model.n - np.outer(mean, mean)
    model.total = deviation / model.n**3
    model.identity_error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return model


def apply(whole: DataFrame, model: Whitening) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each row of whole_vectors and each component."""
    k = len(model.variances)
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    explained = model.variances / model.total

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            m = len(x)
            deviation = [d if d < 2**63 else None for d in model.deviation(x)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ], schema=schema)

    return whole.mapInArrow(rows, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: where the vector stands on the component, in units of its standard deviation.

    Vectors that are null, empty or hold a null or non-finite entry are left out. Equal vectors count once in the fit and
    have rows each; a null id is kept; other columns are not read. Components without variance (constant vectors, fewer
    distinct vectors than components) have no rows, nor has an empty table any. Vectors of different lengths raise
    ValueError. deviation is null where a long cannot hold it.
    """
    whole = whole_vectors(vectors, id_col, vector_col)
    distinct = distinct_vectors(whole)
    model = fit(distinct, components)
    if model is None or not len(model.variances):
        model = Whitening(1, np.zeros(1, np.int64), np.zeros((0, 1)), np.zeros(0))
        return apply(whole.where("false"), model)
    return apply(whole, measured(distinct, model))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
