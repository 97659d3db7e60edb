"""A training corpus from documents: toxic documents go, widespread lines go, one of each group of near copies stays,
documents that hold benchmark items go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwright.llm import common, decontamination, lines, packing, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot score, embed or tokenize; tests hold each stage against its own brute-force version.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents that may be learnt from; documents that score 0.5 or more go, if what is in them
    has raised the score. A model without features, as from no labels, few or those of one class, rejects nothing."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weight, constant = model
    if not weight.any():
        return _documents(docs)
    without_features = 1 / (1 + math.exp(-constant))
    return toxicity.score(_documents(docs), model).where((F.col("_score") < 0.5) | (F.col("_score") <= without_features + 1e-12)).drop("_score")


def drop_widespread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, without lines that stand on many sites; n_chars follows the text.

    A line also has to be in as many different texts: copies are the next stage's, and of each group one is to stay whole.
    """
    cut = lines.remove_widespread_lines(_documents(docs), min_texts=lines.MIN_SITES).drop("n_lines", "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least doc_id stays, of equal rows one.

    Near copies share 0.8 of their five-word shingles or more. Texts without any word are alike too.
    """
    found = simhash.similar_classes(_documents(docs))
    # Of each component one (id, text) stays; a null id only where the component has no other.
    first = F.min(F.struct(F.col("id").isNull().alias("_null"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("t").alias("_t"))).alias("x")
    stays = found.groupBy("root").agg(first).select("x.*")
    rows = _documents(docs).withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(stays, ["_null", "_id", "_t"], "left_semi")
    one = Window.partitionBy("_null", "_id", "_t").orderBy(F.xxhash64("lang", "source", "n_chars"))  # dealt as for the join
    return kept.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaking(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(_documents(docs), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_widespread_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            common.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
