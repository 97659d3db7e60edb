"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each n-gram that occurs in a text (not how often) is a hashed feature. Its scale is the log of the ratio of its smoothed
shares in toxic and other training texts; a logistic regression with a penalty then weighs the scaled features.
Learning is from whole texts of at most MAX_TRAINING labelled rows, those with the least hashes of their ids, one row
for each id, so the same rows at every run. Spark makes their features and counts them; the driver gets the features
that say something and, for each row, which of these it has. Scoring is one narrow pass over whole texts with weights
of a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

SIZES = (3, 5)
BITS = 19
#: Bound on the labelled rows that are learnt from.
MAX_TRAINING = 4000
SMOOTHING = 1.0
#: Features of fewer texts, or whose ratio is nearer to even, say too little.
LEAST_TEXTS, LEAST_RATIO = 8, 1.5
PENALTY = 1e-4
STEPS = 150

_U32 = np.uint32


class Features:
    """The distinct hashed n-grams of a text."""

    def __init__(self, sizes: tuple[int, ...] = SIZES, bits: int = BITS):
        self.sizes, self.shift = sizes, _U32(32 - bits)
        self.seen = np.zeros(1 << bits, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = " ".join((text or "").lower().split())
        points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(_U32)
        points = (points + _U32(1)) * _U32(0x9E3779B1)
        points ^= points >> _U32(15)
        parts = []
        for n in self.sizes:
            if len(points) >= n:
                size = len(points) - n + 1
                h = np.full(size, n, _U32)
                for i in range(n):
                    h = (h ^ points[i : i + size]) * _U32(0x85EBCA6B)
                    h ^= h >> _U32(13)
                parts.append(h * _U32(0xC2B2AE35) >> self.shift)
        if not parts:
            return np.zeros(0, np.int64)
        ids = np.concatenate(parts).astype(np.int64)
        nth = np.arange(len(ids))
        self.seen[ids] = nth
        return ids[self.seen[ids] == nth]  # the last of equal ones


def train(rows: list[np.ndarray], labels: list[int], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each feature and the constant, from rows of distinct features and the log-count ratio of each feature.

    With one class only the score is that class; without rows it is even.
    """
    y = np.array(labels, float)
    weight = np.zeros(len(ratio), np.float32)
    if not len(y) or y.min() == y.max():
        return weight, 0.0 if not len(y) else (20.0 if y[0] else -20.0)
    ids = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), [len(r) for r in rows])
    used, ids = np.unique(ids, return_inverse=True)
    x = ratio[used][ids].astype(np.float32)
    w, b = np.zeros(len(used)), 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g2, gb2 = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):  # full gradient, step scaled for each weight by its past gradients
        z = np.bincount(owner, x * w[ids], len(y)) + b
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(ids, x * error[owner], len(used)) + PENALTY * w
        gb = error.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.2 * g / np.sqrt(g2)
        b -= 0.2 * gb / np.sqrt(gb2)
    weight[used] = (w * ratio[used]).astype(np.float32)
    return weight, float(b)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """Rows (doc_id, toxic, features) of at most max_training labelled ids, half from each class or what there is.

    Ids whose text has a crc32 that 5 divides are never among them. Labels other than 0 and 1 are passed over; with
    several labels for an id the larger counts, with several rows the one whose text has the least hash.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = F.xxhash64(F.lit(8), F.col("doc_id"))
    some = known.where("toxic = 1").orderBy(order).limit(max_training // 2).union(known.where("toxic = 0").orderBy(order).limit(max_training // 2))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in common.chunks(batches, "text"):
            found = [np.sort(of(t)) for t in batch.column("text").to_pylist()]
            counts = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), common.lists(np.concatenate(found).astype(np.int32), counts, pa.int32())], ["doc_id", "toxic", "features"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, features array<int>")


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """For each feature log((s + texts that are toxic with it) / (2 s + toxic texts)) less the same of the others, s being SMOOTHING.

    It is 0 for features of fewer than LEAST_TEXTS texts and for those nearer to even than LEAST_RATIO.
    """
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= LEAST_TEXTS)
    share = lambda n, k: F.log((n + SMOOTHING) / (2 * SMOOTHING + sizes.get(k, 0)))
    scaled = held.select("feature", (share(F.col("bad"), 1) - share(F.col("n") - F.col("bad"), 0)).alias("ratio"))
    told = scaled.where(F.abs("ratio") >= LEAST_RATIO).toArrow()  # 2**BITS rows at most
    ratio = np.zeros(1 << BITS)
    ratio[np.asarray(told.column("feature"))] = np.asarray(told.column("ratio"))
    return ratio


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> tuple[np.ndarray, float]:
    """Weights of the features and the constant, learnt from training_rows."""
    rows = common.stage(training_rows(docs, labels, max_training), "training")
    ratio = log_count_ratios(rows)
    told = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            keep = told.value[flat]
            counts = np.bincount(owner[keep], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), common.lists(flat[keep], counts, pa.int32())], batch.schema.names)

    got = rows.mapInArrow(known, rows.schema).toArrow().sort_by("doc_id")
    common.drop(rows)
    features = got.column("features").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    return train([np.asarray(x.values) for x in features], got.column("toxic").to_pylist(), ratio)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs with a column _score, 0 to 1, of their whole text; null counts as empty.
    A column of that name is replaced."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    docs = common.without(docs, "_score")
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, constant = weights.value
        of = Features()
        for batch in common.chunks(batches, "text"):
            z = np.array([weight[of(t)].sum(dtype=float) for t in batch.column("text").to_pylist()]) + constant
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, "_score"])

    return docs.mapInArrow(rows, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels, then rows (doc_id, held_out, score, predicted) for every row of docs (doc_id, text; others are not read).

    Empty and null texts get the score of a text without features. A null doc_id is kept and is never learnt from; it
    counts as not held out. Equal rows get equal scores; without usable labels all scores are 0.5.
    """
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
