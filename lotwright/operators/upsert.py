"""Keyed state on files: change counters, merge policies, last write wins. Each gives the state that is to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, change): inserted, updated, unchanged or missing, by null-safe comparison of the columns as one struct."""
    b = before.select(key, F.struct(*columns).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a"))
    change = F.when(F.col("_b").isNull(), "inserted").when(F.col("_a").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return b.join(a, key, "full").select(key, change.alias("change"))


def import_counts(known: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: how many rows of an import are new, change a known row, or are skipped (as known, without a key, repeated).

    fresh is looked up once by its keys; of rows of one key the one with the least columns counts.
    """
    once = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_a"))
    both = once.join(known.select(key, F.struct(*columns).alias("_b")), key, "left")
    counts = both.agg(F.count_if(F.col("_b").isNull()).alias("new"), F.count_if(F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("updated"))
    every = fresh.agg(F.count(F.lit(1)).alias("_n"))
    return counts.crossJoin(F.broadcast(every)).select("new", "updated", (F.col("_n") - F.col("new") - F.col("updated")).alias("skipped"))  # single rows


def merge(state: DataFrame, incoming: DataFrame, key: str, always: list[str], fill: list[str], locked: str | None = None) -> DataFrame:
    """The new state. always: the incoming value where there is one; fill: only where the state has none (null or
    blank); a row whose locked column is true takes nothing but always. One incoming row for each key is assumed."""
    s, i = state.alias("s"), incoming.alias("i")
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNull()
    out = [F.coalesce(F.col(f"s.{key}"), F.col(f"i.{key}")).alias(key)]
    for c in state.columns:
        if c == key:
            continue
        if c in always:
            out.append(F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c))
        elif c in fill:
            open_ = F.lit(True) if locked is None else ~F.coalesce(F.col(f"s.{locked}"), F.lit(False))
            out.append(F.when(blank(f"s.{c}") & open_, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.col(f"s.{c}").alias(c))
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full").select(*out)


def last_write(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    from .history import latest

    return latest(df, keys, F.col(ts), F.col(tie))
