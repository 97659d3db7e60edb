"""Pages found on pages: which addresses can be reached from some, in how many steps, and which could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import with_checkpoints


def reached(pages: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (address, depth, status, cause) of all addresses that seeds (address) lead to over the links of pages.

    pages: address, links array<string>, cause (why it could not be read, or null); an address may have several. It is
    read if one of its pages could be, and then all links of these count; failed, with the least cause, if none could;
    unknown if it has no page. A round looks only at what the round before has found, and an anti-join takes away
    what is known, so no address is looked at twice. Null addresses and links are passed over.
    """
    with_checkpoints(pages.sparkSession)
    usable = pages.where("address IS NOT NULL")
    links = usable.where("cause IS NULL").select("address", F.explode("links").alias("link")).where("link IS NOT NULL").distinct().checkpoint()
    found = [seeds.where("address IS NOT NULL").select("address").distinct().withColumn("depth", F.lit(0)).checkpoint()]
    while found[-1].take(1):
        if len(found) > most_rounds:
            raise RuntimeError(f"more than {most_rounds} steps from the seeds")
        known = found[0]
        for f in found[1:]:
            known = known.union(f)
        fresh = found[-1].join(links, "address").select(F.col("link").alias("address")).distinct().join(known, "address", "left_anti")
        found.append(fresh.withColumn("depth", F.lit(len(found))).checkpoint())
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    state = usable.groupBy("address").agg(F.every(F.col("cause").isNotNull()).alias("_failed"), F.min("cause").alias("_cause"))
    status = F.when(F.col("_failed").isNull(), "unknown").when(F.col("_failed"), "failed").otherwise("read")
    return every.join(state, "address", "left").select("address", "depth", status.alias("status"), F.when(F.col("_failed"), F.col("_cause")).alias("cause"))
