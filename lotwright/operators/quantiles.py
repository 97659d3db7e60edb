"""Quantiles by nearest rank from sketches that are made once and added up: of hours to days, of tasks to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items a sketch keeps; its error of rank, in shares, for 99 of 100 sketches is below ERROR.
SKETCH_ITEMS, ERROR = 800, 0.004


def sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows (by, sketch, n, least, most) of the values that are not null: a KLL sketch of a bounded number of items each."""
    held = rows.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    return held.groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(SKETCH_ITEMS)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of smaller groups added up to those of by; the values are not read again."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_ITEMS)).alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: list[float], totals: DataFrame | None = None) -> DataFrame:
    """Rows (by, share, value) of the exact value at rank ceil(share * n) of each group.

    A group's sketch (totals, of sketches or merged, or made here) says between which two values the rank most likely
    lies. One pass then counts what is below them and, value by value, what is between. Whether the rank did lie there is
    seen from the counts; groups where it did not are counted in full. rows is read up to three times.
    """
    names, totals = by, sketches(rows, by, value) if totals is None else totals
    near = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, min(1.0, share))))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), near(s - 2 * ERROR).alias("low"), near(s + 2 * ERROR).alias("high")) for s in shares])).alias("_s")
    bounds = totals.select(*names, "n", "least", "most", each).select(*names, "_s.*", F.greatest(F.ceil(F.col("_s.share") * F.col("n")), F.lit(1)).cast("long").alias("rank"), "least", "most")

    def counted(ask: DataFrame) -> DataFrame:
        v = F.col(value).cast("double")
        met = rows.where(v.isNotNull()).select(*names, v.alias("_v")).join(ask, names)
        # What is below counts as one value, so a group gives as many rows as there are values between its bounds.
        at = F.when(F.col("_v") < F.col("low"), F.lit(None)).otherwise(F.col("_v"))
        counts = met.where(F.col("_v") <= F.col("high")).groupBy(*names, "share", "rank", at.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*names, "share").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counts.withColumn("_upto", F.sum("_c").over(w))
        hit = upto.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank")) & F.col("_at").isNotNull())
        return hit.select(*names, "share", F.col("_at").alias("value"))

    first = counted(bounds.select(*names, "share", "rank", "low", "high"))
    missed = bounds.join(first, [*names, "share"], "left_anti").select(*names, "share", "rank", F.col("least").alias("low"), F.col("most").alias("high"))
    return first.unionByName(counted(missed))


def histogram(rows: DataFrame, by: list[str], state: str) -> DataFrame:
    """Rows (by, histogram): how often each state occurs, as a map in the order of states."""
    counts = rows.groupBy(*by, state).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(state), F.lit("unknown")).alias("state"), "_n")))).alias("histogram"))
