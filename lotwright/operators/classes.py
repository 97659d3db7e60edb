"""Pairs of rows by way of classes: rows that a rule cannot tell apart are judged once, and told one by one at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a class that stand in one row, on average; larger classes are dealt to several.
HELD = 256


def classed(rows: DataFrame, keys: list[str], ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """The classes of rows with equal keys, as rows (class, *keys), and their ids, as rows (class, part, ids).

    A class is named by its least id and a hash of its keys, and nulls are equal. Its ids are dealt by hash to parts of
    some HELD.
    """
    keyed = rows.select(F.struct(*keys).alias("_keys"), F.col(ident).alias("id"))
    least = F.min("id").alias("_least")
    table = keyed.groupBy("_keys").agg(least, F.ceil(F.count(F.lit(1)) / HELD).alias("_parts")).select(F.struct("_least", F.xxhash64("_keys").alias("_hash")).alias("class"), "_parts", "_keys")
    dealt = keyed.join(table, "_keys").select("class", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("part"), "id")
    return table.select("class", "_keys.*"), dealt.groupBy("class", "part").agg(F.collect_list("id").alias("ids"))


def told(found: DataFrame, held: DataFrame, *more: str, one_way: bool = False) -> DataFrame:
    """Rows (left, right, *more) for each pair of different ids, left < right, of the classes l and r of found.

    found: l, r, *more, each two classes in one order only; a class may be found with itself. one_way: left is of l and
    right of r. held: of classed(). What is dealt out are parts, not pairs, and to so many tasks as shuffles have, since
    few parts may make many pairs.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (held.select(F.col("class").alias(s), F.col("part").alias(f"_{s}_part"), F.col("ids").alias(f"_{s}")) for s in "lr")
    met = found.join(l, "l").join(r, "r").withColumn("_ordered", F.lit(one_way) | (F.col("l") == F.col("r")))
    met = met.repartition(tasks, F.xxhash64("l", "_l_part"), F.xxhash64("r", "_r_part")).select(*more, "_ordered", "_l", "_r")
    ids = met.select(*more, "_ordered", F.explode("_l").alias("_i"), "_r").select(*more, "_ordered", "_i", F.explode("_r").alias("_j"))
    ids = ids.where((F.col("_i") < F.col("_j")) | (~F.col("_ordered") & (F.col("_i") > F.col("_j"))))
    return ids.select(F.least("_i", "_j").alias("left"), F.greatest("_i", "_j").alias("right"), *more)
