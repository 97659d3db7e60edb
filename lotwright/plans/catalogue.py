"""The queries over the driver's tables: name, function and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "registry_listing"


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""

    def keep(f):
        if name in QUERIES and QUERIES[name].__module__ != f.__module__:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


from . import assets, facts, links, listings, quality, registry, sources, state, timelines, wordings  # noqa: E402, F401  they register their queries
