"""Counters of data quality and of copies, each by one aggregate a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a failed lookup is no longer waiting in.
SETTLED = ("resolved", "terminal")


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)


def snapshot(lots: DataFrame, places: DataFrame, failures: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of thirteen counters.

    lots: status, archived, duplicate_of, address, cadastral_number, current_price, start_price, needs_geo_check,
    market_price, advice; places: lot_id; failures: status. Nulls count as missing, and as no for what is true or false;
    a failure without a status counts for nothing.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    absent = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cs])
    of_lots: dict[str, Column] = {
        "total_lots": F.lit(True),
        "active_lots": F.col("status") == "active",
        "archived_lots": F.col("archived"),
        "duplicate_lots": F.col("duplicate_of").isNotNull(),
        "missing_address": blank("address"),
        "missing_cadastre": blank("cadastral_number"),
        "missing_price": absent("current_price", "start_price"),
        "geo_attention_lots": F.col("needs_geo_check"),
        "unknown_status_lots": F.col("status") == "unknown",
        "ai_analyzed_lots": ~absent("market_price", "advice"),
    }
    return side_by_side(
        [
            lots.agg(*[F.count_if(test).alias(name) for name, test in of_lots.items()]),
            places.agg(F.count_distinct("lot_id").alias("geocoded_lots")),
            failures.agg(F.count_if(~F.col("status").isin(*SETTLED)).alias("queued_geo_failures")),
            versions.agg(F.count(F.lit(1)).alias("document_versions")),
        ]
    )


def reconcile(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Rows of source and of its copy in each group, and whether they are as many; a group that one lacks has 0 there."""
    counted = [df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((source, "source_rows"), (target, "target_rows"))]
    a, b = counted[0].alias("a"), counted[1].alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    n = {c: F.coalesce(c, F.lit(0)) for c in ("source_rows", "target_rows")}
    return a.join(b, same, "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by], *[v.alias(c) for c, v in n.items()], (n["source_rows"] == n["target_rows"]).alias("matches"))
