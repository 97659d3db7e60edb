"""The engine behind an API: one method for each question that a client asks, over tables given by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geo, money, regions, text
from .operators import documents, history, listing


class Engine:
    """Tables: lots (id, title, description, address, category, status, region_code, region_name, start_price,
    current_price, discount_percent, rating, risk_score, archived, published_at, lat, lon), and where asked for
    watchlist (user_id, lot_id, at), notes (lot_id, content, at), versions (lot_id, version, content, size)."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table {name}") from None

    def _order(self) -> dict[str, Column]:
        c = F.col
        return {"rating": c("rating").desc_nulls_last(), "price_asc": c("current_price").asc_nulls_last(), "price_desc": c("current_price").desc_nulls_last(), "discount": c("discount_percent").desc_nulls_last(), "newest": c("published_at").desc_nulls_last()}

    def find(self, region: str | None = None, categories: list[str] | None = None, statuses: list[str] | None = None, price: tuple = (0, 1e12), risk: tuple = (None, None), term: str | None = None) -> DataFrame:
        """Lots that are not archived and meet all that is given; a lot without a price is never among them."""
        found = self.lots.where(~F.coalesce("archived", F.lit(False)))
        if region:
            found = found.where((F.col("region_code") == region) | (regions.key("region_name") == regions.key(F.lit(region))))
        return listing.facets(found, {"category": categories or [], "status": statuses or []}, {"current_price": price, "risk_score": risk}, ["title", "description", "address"], term)

    def listing(self, page: int = 1, size: int = 12, sort: str | None = None, **filters) -> DataFrame:
        rows = listing.page(listing.ordered(self.find(**filters), self._order(), sort, "rating", "id"), page, min(size, 100))
        return rows.withColumn("description", text.shorten("description")).withColumn("start_price", F.nullif("start_price", F.lit(0.0)))

    def lot(self, ident: int) -> DataFrame:
        return self.lots.where(F.col("id") == ident)

    def stats(self) -> DataFrame:
        return self.lots.groupBy("region_code").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count("rating").alias("rated"), F.round(F.avg("discount_percent"), 2).alias("avg_discount"))

    def map_lots(self, west: float, south: float, east: float, north: float, limit: int = 3000, **filters) -> DataFrame:
        """Lots in the box, and whether there are more than the limit."""
        return listing.truncated(self.find(**filters).where(geo.in_box(F.col("lon"), F.col("lat"), west, south, east, north)), min(limit, 5000), F.col("id"))

    def nearest(self, lat: float, lon: float, k: int = 10) -> DataFrame:
        km = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
        return self.lots.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("km", km).orderBy("km", "id").limit(k)

    def max_bid(self, ident: int, **given: float) -> DataFrame:
        """Three scenarios for a lot; sale_price is its own price unless given. See money.bid_scenarios for the rest."""
        names = ("repair", "legal", "holding", "months", "taxes", "commission", "target", "reserve", "capital")
        values = {n: F.lit(float(given.get(n, 6 if n == "months" else 0))) for n in names}
        return money.bid_scenarios(self.lot(ident).select("id", "current_price"), sale=F.lit(given["sale"]) if "sale" in given else F.col("current_price"), bid=F.lit(given.get("bid")), **values)

    def watched(self, user: str) -> DataFrame:
        """The lots that a user watches: toggled an odd number of times."""
        on = history.toggled_on(self.watchlist.where(F.col("user_id") == user), ["lot_id"]).select(F.col("lot_id").alias("id"))
        return self.lots.join(on, "id", "left_semi")

    def recent_notes(self, ident: int, n: int = 20) -> DataFrame:
        return self.notes.where(F.col("lot_id") == ident).orderBy(F.col("at").desc(), "content").limit(n)

    def document_changes(self, ident: int) -> DataFrame:
        return documents.differences(self.versions.where(F.col("lot_id") == ident), "lot_id", "version", "content", "size")

    def regions(self) -> DataFrame:
        return self.lots.select("region_code", "region_name").where("region_code IS NOT NULL").distinct().select(regions.label("region_code", "region_name").alias("label")).orderBy("label")
