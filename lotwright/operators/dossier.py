"""Lots with what belongs to them: cards of sources, procedures, documents, runs with their sources; cached cards; archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dossiers(lots: DataFrame, cards: DataFrame, documents: DataFrame, lot: str, card: str, order: list[str]) -> DataFrame:
    """A row for each lot with its cards, each with its documents, as nested arrays.

    cards hold lot and card, documents card and what else they have, by which (order) they are sorted in a card; cards are
    sorted by their key. Two equi-joins, each after its side has been gathered by key. A lot without cards and a card
    without documents have empty arrays.
    """
    rest = [c for c in documents.columns if c not in (card, *order)]
    held = documents.groupBy(card).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("documents"))
    kinds = dict(held.dtypes)["documents"]
    filled = cards.join(held, card, "left").withColumn("documents", F.coalesce("documents", F.array().cast(kinds)))
    own = [c for c in cards.columns if c not in (lot, card)]
    gathered = filled.groupBy(lot).agg(F.array_sort(F.collect_list(F.struct(card, *own, "documents"))).alias("cards"))
    return lots.join(gathered, lot, "left").withColumn("cards", F.coalesce("cards", F.array().cast(dict(gathered.dtypes)["cards"])))


def first_by_procedure(asked: DataFrame, cards: DataFrame, number: str, source: str, ident: str) -> DataFrame:
    """asked (number, source: a pattern in any case) with ident: the least of the cards of that number and source; null if none."""
    found = asked.select(number, source).distinct().join(cards.select(number, F.col(source).alias("_source"), ident), number).where(F.expr(f"_source ILIKE {source}"))
    return asked.join(found.groupBy(number, source).agg(F.min(ident).alias(ident)), [number, source], "left")


def contradictions(links: DataFrame, lots: DataFrame, assets: DataFrame, lot: str, asset: str) -> DataFrame:
    """The links (lot, asset) that are not whole, with reason: no lot, no asset, or a lot that names another asset.

    lots hold lot and _asset, the asset that the lot itself names, if any; assets hold asset.
    """
    both = links.join(lots.select(lot, F.col("_asset"), F.lit(True).alias("_lot")), lot, "left").join(assets.select(asset, F.lit(True).alias("_known")), asset, "left")
    reason = F.when(F.col("_lot").isNull(), "no lot").when(F.col("_known").isNull(), "no asset").when(F.col("_asset") != F.col(asset), "another asset")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select(*links.columns, "reason")


def with_sources(runs: DataFrame, parts: DataFrame, run: str, order: str) -> DataFrame:
    """runs with parts: an array of each run's rows of parts by order; empty where it has none."""
    rest = [c for c in parts.columns if c not in (run, order)]
    held = parts.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("parts"))
    return runs.join(held, run, "left").withColumn("parts", F.coalesce("parts", F.array().cast(dict(held.dtypes)["parts"])))


def source_counters(rows: DataFrame, source: str, failed: Column) -> DataFrame:
    """Rows (source, seen, failed, state): success if nothing of a source failed, failed if all did, else partial."""
    counted = rows.groupBy(source).agg(F.count(F.lit(1)).alias("seen"), F.count_if(failed).alias("failed"))
    return counted.withColumn("state", F.when(F.col("failed") == 0, "success").when(F.col("failed") == F.col("seen"), "failed").otherwise("partial"))


def cached(cards: DataFrame, raw: str, region: str | None = None, search: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Stored cards instead of the live source: not archived, the region's name (or that in raw) containing region, title or
    address containing search, the current or else the start price within bounds; nothing in search is a wildcard."""
    out = cards.where(~F.coalesce("is_archived", F.lit(False)))
    if region:
        out = out.where(F.lower(F.coalesce("region_name", F.get_json_object(raw, "$.region_name"))).contains(region.lower()))
    if search:
        out = out.where(F.lower(F.coalesce("title", F.lit(""))).contains(search.lower()) | F.lower(F.coalesce("address", F.lit(""))).contains(search.lower()))
    price = F.coalesce("current_price", "start_price")
    for bound, holds in ((low, price >= F.lit(low)), (high, price <= F.lit(high))):
        if bound is not None:
            out = out.where(holds)
    return out


def archived(lots: DataFrame, now: Column) -> DataFrame:
    """lots with closed ones archived: is_archived, archived_at and closed_at are set where they are not; others stay."""
    due = (F.col("auction_status") == "closed") & ~F.coalesce("is_archived", F.lit(False))
    set_ = lambda c: F.when(F.coalesce(due, F.lit(False)), F.coalesce(c, now)).otherwise(F.col(c)).alias(c)
    new = {"is_archived": (F.coalesce("is_archived", F.lit(False)) | F.coalesce(due, F.lit(False))).alias("is_archived"), "archived_at": set_("archived_at"), "closed_at": set_("closed_at")}
    return lots.select(*[new.get(c, F.col(c)) for c in lots.columns])


def overview(lots: DataFrame, syncs: DataFrame) -> DataFrame:
    """One row: lots, active and rated ones, and when a region was last brought up to date."""
    counts = lots.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("auction_status") == "active").alias("active"), F.count("rating").alias("with_rating"))
    return counts.crossJoin(F.broadcast(syncs.agg(F.max("last_success_at").alias("last_sync"))))  # single rows
