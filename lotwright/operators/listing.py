"""Faceted listings: filters, text search, sort modes, pages, viewports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(columns: list[Column], term: str | None) -> Column:
    """Any of the columns holds the term, whatever the case; % and _ stand for themselves. Blank: everything."""
    if not term or not term.strip():
        return F.lit(True)
    low = term.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c.cast("string")).contains(low), F.lit(False)) for c in columns])


def facets(df: DataFrame, isin: dict[str, list] | None = None, between: dict[str, tuple] | None = None, search_in: list[str] | None = None, term: str | None = None) -> DataFrame:
    """Rows that meet every facet: values of a list, ranges (an open end is None), and a term in any column."""
    for column, (low, high) in (between or {}).items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{column}: the range is empty")
        if low is not None:
            df = df.where(F.col(column) >= low)
        if high is not None:
            df = df.where(F.col(column) <= high)
    for column, values in (isin or {}).items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df.where(search([F.col(c) for c in search_in or []], term)) if search_in else df


def ordered(df: DataFrame, modes: dict[str, Column], mode: str | None, default: str, tie: str) -> DataFrame:
    """By the named mode (an unknown one is the default), ties by a unique column, so that pages are the same each time."""
    return df.orderBy(modes.get(mode, modes[default]), F.col(tie).asc())


def sort_number(c: Column | str) -> Column:
    """A column's numbers to sort by: what is none sorts as -1."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(-1.0))


def sort_text(c: Column | str) -> Column:
    """A column's texts to sort by, whatever their case; null sorts as empty."""
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page number, from 1; the plan is a top-k over number * size rows, not a full sort."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size start at 1")
    return df.offset((number - 1) * size).limit(size)


def unrated(df: DataFrame, rating: str) -> DataFrame:
    """Rows that no rating was given to yet."""
    return df.where(F.col(rating).isNull())


def due_first(queue: DataFrame, due: Column, failed_at: str, tie: str, limit: int = 100) -> DataFrame:
    """The due rows of a retry queue, the oldest failure first; limit is held between 1 and 1000."""
    return queue.where(due).orderBy(F.col(failed_at).asc(), F.col(tie).asc()).limit(min(max(limit, 1), 1000))


def backfill_order(urgent: str, updated: str, tie: str) -> list[Column]:
    """Urgent rows first, then the latest updated; what was never updated comes last."""
    return [F.coalesce(F.col(urgent), F.lit(False)).desc(), F.col(updated).desc_nulls_last(), F.col(tie).asc()]


def truncated(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first limit rows with a column truncated that says whether there were more; limit + 1 rows are looked at."""
    rows = df.orderBy(*order).limit(limit + 1)
    more = rows.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(more))  # one row
