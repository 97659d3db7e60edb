"""Connected components by random contraction: what hangs together becomes one node, round by round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may go without, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lotwright-")


def with_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def staged(df: DataFrame) -> DataFrame:
    """df written below the shared folder and read again. A checkpoint keeps what is known of its columns, which grows with every
    join of a loop until planning takes longer than the work; files do not."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lotwright/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """Rows (node, component) for each node that a link ties to another; component is the least node.

    In a round every node joins the one of it and its neighbours that a hash, another one each round, puts first, and
    links then tie what has been joined. Some third of the nodes is left each time, of a chain too, so the rounds grow
    with the logarithm of the nodes. No node's links are gathered; a node with many is a partial aggregate. Ids are
    longs. Links with a null end or of a node to itself tie nothing.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    open_ = staged(ends.union(ends.select("b", "a")).distinct())
    joined = []
    while open_.take(1):
        first = F.min(F.struct(F.xxhash64("b", F.lit(len(joined))).alias("h"), F.col("b").alias("to"))).alias("first")
        own = F.struct(F.xxhash64("a", F.lit(len(joined))).alias("h"), F.col("a").alias("to"))
        parents = staged(open_.groupBy("a").agg(first).select(F.col("a").alias("node"), F.least("first", own)["to"].alias("parent")))
        joined.append(parents)
        of = lambda end: parents.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_parent"))  # noqa: B023, E731
        met = open_.join(of("a"), "a").join(of("b"), "b").where("a_parent <> b_parent")
        open_ = staged(met.select(F.col("a_parent").alias("a"), F.col("b_parent").alias("b")).distinct())
    if not joined:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = joined[-1]
    for parents in reversed(joined[:-1]):
        later = named.select(F.col("node").alias("parent"), F.col("parent").alias("last"))
        named = parents.join(later, "parent", "left").select("node", F.coalesce("last", "parent").alias("parent"))
    least = named.groupBy("parent").agg(F.min("node").alias("component"))
    return staged(named.join(least, "parent").select("node", "component"))
