"""Document versions by content, differences between them, retention of raw payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(df: DataFrame, content: str, ident: str) -> DataFrame:
    """One row for each content: its sha256, the first id that has it, and how many have."""
    return df.select(F.sha2(F.col(content), 256).alias("sha256"), ident).groupBy("sha256").agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def new_versions(known: DataFrame, incoming: DataFrame, document: str, content: str) -> DataFrame:
    """Incoming rows whose (document, sha256) is not known, each once."""
    hashed = incoming.withColumn("sha256", F.sha2(F.col(content), 256)).dropDuplicates([document, "sha256"])
    return hashed.join(known.select(document, "sha256"), [document, "sha256"], "left_anti")


def differences(df: DataFrame, group: str, order: str, content: str, size: str) -> DataFrame:
    """Each version beside the one before in its group: whether the content differs, and by how much its size."""
    w = Window.partitionBy(group).orderBy(order)
    hashed = df.select(group, order, F.sha2(F.col(content), 256).alias("_h"), F.col(size).alias("_n"))
    pairs = hashed.select(group, order, F.lag(order).over(w).alias("previous"), (F.lag("_h").over(w) != F.col("_h")).alias("changed"), (F.col("_n") - F.lag("_n").over(w)).alias("size_change"))
    return pairs.where("previous IS NOT NULL")


def retained(df: DataFrame, payload: str, created: Column, as_of: Column, days: int) -> DataFrame:
    """The rows, with payloads older than so many days emptied."""
    return df.withColumn(payload, F.when(created >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.col(payload)))
