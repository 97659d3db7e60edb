"""Manual decisions: merging and splitting lots, valuations by content, the provider's feature that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(ties: DataFrame, primary: int, secondary: int) -> DataFrame:
    """Ties (id, primary) with secondary, and all that was tied to it, tied to primary's own primary."""
    if primary == secondary:
        raise ValueError("a lot is not merged with itself")
    own = ties.where(F.col("id") == primary).agg(F.max("primary").alias("_top"))  # one row
    moved = F.when((F.col("id") == secondary) | (F.col("primary") == secondary), F.coalesce("_top", F.lit(primary))).otherwise(F.col("primary"))
    return ties.crossJoin(F.broadcast(own)).select("id", moved.alias("primary"))


def split(ties: DataFrame, lot: int) -> DataFrame:
    """Ties with this lot its own primary again."""
    return ties.select("id", F.when(F.col("id") == lot, F.col("id")).otherwise(F.col("primary")).alias("primary"))


def audit(action: str, lot: int, other: int | None, user: str, reason: str, as_of: Column) -> list[Column]:
    """The columns of a row of the review log."""
    given = {"action": F.lit(action), "lot_id": F.lit(lot).cast("long"), "other_id": F.lit(other).cast("long"), "user_id": F.lit(user), "reason": F.lit(reason), "at": as_of}
    return [v.alias(k) for k, v in given.items()]


def compressed(ties: DataFrame) -> DataFrame:
    """Ties whose primary is a primary itself, however long the chain was: each round halves it. A cycle of ties is an error."""
    rounds = ties.count().bit_length() + 1
    for _ in range(rounds):
        up = ties.select(F.col("id").alias("primary"), F.col("primary").alias("_up"))
        after = ties.join(up, "primary", "left").select("id", F.coalesce("_up", "primary").alias("primary"), (F.coalesce("_up", "primary") != F.col("primary")).alias("_moved")).checkpoint()
        if not after.where("_moved").head(1):
            return ties
        ties = after.drop("_moved")
    raise ValueError("ties lead in a circle")


def valuation_key(*columns: str) -> Column:
    """The same for equal contents, whatever the order in which columns are named."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def fitting_feature(features: Column, identifier: Column) -> Column:
    """The first of an array of texts that holds the identifier, else the first."""
    return F.coalesce(F.try_element_at(F.filter(features, lambda x: x.contains(identifier)), F.lit(1)), F.try_element_at(features, F.lit(1)))


def confirmed(scores: DataFrame, key: str, score: str, importance: str, needed: int = 2) -> DataFrame:
    """The best candidate of each key by score, then importance; none where the score is too low."""
    best = scores.groupBy(key).agg(F.max_by(F.struct(*[c for c in scores.columns if c != key]), F.struct(score, importance)).alias("_b"))
    return best.select(key, "_b.*").where(F.col(score) >= needed)
