"""Pages of several sources: merged pages, duplicates across pages, crawl counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_page(rows: DataFrame, category: str, ident: str, date: str, number: int, size: int) -> DataFrame:
    """A page of the categories' rows merged by date, newest first.

    Of each category only the rows that can reach the page are looked at (a window group limit), then a top-k is taken.
    """
    w = Window.partitionBy(category).orderBy(F.col(date).desc(), F.col(ident))
    reach = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= number * size).drop("_n")
    once = reach.dropDuplicates([ident])
    return once.orderBy(F.col(date).desc(), F.col(ident)).offset((number - 1) * size).limit(size)


def crawl(rows: DataFrame, ident: str, page: str, position: str, max_items: int | None = None) -> DataFrame:
    """The first row of each id by page and position; rows without an id go; max_items ends the crawl."""
    w = Window.partitionBy(ident).orderBy(page, position)
    once = rows.where(F.col(ident).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy(page, position).limit(max_items) if max_items is not None else once


def crawl_report(rows: DataFrame, ident: str, page: str, total: int | None) -> DataFrame:
    """One row: pages, rows, ids, repeated rows, rows without an id, and what the source's own total leaves unexplained."""
    out = rows.agg(F.count_distinct(page).alias("pages"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(ident).alias("n_ids"), F.count_if(F.col(ident).isNull()).alias("without_id"))
    out = out.withColumn("repeated", F.col("n_rows") - F.col("without_id") - F.col("n_ids"))
    return out.withColumn("unexplained", F.lit(total) - F.col("n_rows") if total is not None else F.lit(None).cast("long"))


def crawl_ends(pages: DataFrame, rows: DataFrame, source: str, ident: str, size: int, max_pages: int = 500, max_items: int | None = None) -> DataFrame:
    """Where and why each source's crawl ends: (source, page, reason, n_ids, n_pages).

    pages: source, page (from 1), n_items, total_pages, has_more, error; rows: source, page, ident. On each page the first
    of these ends it: an error, enough different ids, the last page by the source's own number, an empty page, a page that
    is not full and says that none follows, the most pages. A source that none of these ends was read to its last page.
    Windows are over pages, of which a source has max_pages at most.
    """
    within = pages.where(F.col("page") <= max_pages)
    first = rows.where(F.col(ident).isNotNull()).groupBy(source, ident).agg(F.min("page").alias("page"))
    fresh = first.groupBy(source, "page").agg(F.count(F.lit(1)).alias("_new"))
    so_far = within.join(fresh, [source, "page"], "left").withColumn("_ids", F.sum(F.coalesce("_new", F.lit(0))).over(Window.partitionBy(source).orderBy("page")))
    numbered = F.col("total_pages").isNotNull()
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_error")))
    if max_items is not None:
        reason = reason.when(F.col("_ids") >= max_items, f"max_items={max_items}")
    reason = (
        reason.when(numbered & (F.col("page") >= F.col("total_pages")), "reached_total_pages")
        .when(~numbered & (F.col("n_items") == 0), "empty_page")
        .when(~numbered & ~F.coalesce("has_more", F.lit(True)) & (F.col("n_items") < size), "has_more_false")
        .when(F.col("page") == max_pages, "max_pages")
    )
    told = so_far.withColumn("_why", reason)
    ends = told.groupBy(source).agg(F.coalesce(F.min(F.when(F.col("_why").isNotNull(), F.col("page"))), F.max("page")).alias("_end"))
    seen = told.join(ends, source).where(F.col("page") <= F.col("_end"))
    last = F.struct("page", F.coalesce("_why", F.lit("max_pages")).alias("reason"), F.col("_ids").alias("n_ids"))
    return seen.groupBy(source).agg(F.max_by(last, "page").alias("_l"), F.count(F.lit(1)).alias("n_pages")).select(source, "_l.page", "_l.reason", "_l.n_ids", "n_pages")
