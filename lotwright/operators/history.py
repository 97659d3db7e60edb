"""State over time: latest rows, first occurrences, transitions, absences, sliding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the greatest by order (columns that compare, the last resort unique). A partial aggregate,
    so a key with many rows is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def first_occurrence(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def transitions(df: DataFrame, keys: list[str], state: str, *order: Column) -> DataFrame:
    """The rows at which a key's state differs from the one before, with it as previous; the first is one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("previous", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w))
    return seen.where((F.col("_n") == 1) | ~F.col("previous").eqNullSafe(F.col(state))).drop("_n")


def valid_ranges(df: DataFrame, keys: list[str], state: str, at: str, *tie: Column) -> DataFrame:
    """Transitions with valid_from and valid_to, which is null for the present one."""
    changed = transitions(df, keys, state, F.col(at), *tie)
    w = Window.partitionBy(*keys).orderBy(F.col(at), *tie)
    return changed.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def observations(known: DataFrame, seen: DataFrame, key: str, state: str) -> DataFrame:
    """What is to be appended to a history: rows of seen whose state is not the one last known, with it as previous.

    known and seen hold a row for each key; a row without a state is no observation.
    """
    before = known.select(key, F.col(state).alias("previous"))
    return seen.where(F.col(state).isNotNull()).join(before, key, "left").where(~F.col("previous").eqNullSafe(F.col(state)))


def absent_runs(seen: DataFrame, runs: DataFrame, key: str, run: str, needed: int = 2) -> DataFrame:
    """Keys that the last runs in a row did not see, with how many: of those seen before, after complete runs only.

    seen: (key, run); runs: (run, complete), a table of the runs. Runs that are not complete count for nothing.
    """
    done = runs.where("complete").select(run)
    last = seen.join(F.broadcast(done), run, "left_semi").groupBy(key).agg(F.max(run).alias("last_seen"))
    # The number of complete runs after each run: of a table as small as the number of runs.
    after = done.select(F.col(run).alias("last_seen"), (F.count(F.lit(1)).over(Window.orderBy(F.col(run).desc())) - 1).alias("missed"))
    return last.join(F.broadcast(after), "last_seen").where(F.col("missed") >= needed).select(key, "last_seen", "missed")


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """For each row the number of the key's rows in the seconds up to it, the row itself included, the far end not."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("n_recent", F.count(F.lit(1)).over(w))


def toggled_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys toggled an odd number of times."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("toggles")).where(F.col("toggles") % 2 == 1)
