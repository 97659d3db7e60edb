"""Connectors: paged sources with a cursor, as Spark data sources, and their registry.

A connector says how many pages there are and gives the rows of one page; Spark reads a page a partition. Filters that
the source understands are pushed to it as parameters; the others stay with Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

@dataclass
class Page:
    """Rows of a page, and the cursor of the next one, or none."""

    rows: list[dict]
    cursor: str | None = None
    total: int | None = None


@dataclass
class Connector:
    """A source: its name, what it can filter by (column to parameter), and a function of (parameters, cursor) to a page."""

    name: str
    fetch: Callable[[dict[str, Any], str | None], Page]
    filters: dict[str, str] = field(default_factory=dict)
    page_size: int = 20


class Registry:
    """Connectors by name; a name is taken once."""

    def __init__(self):
        self._makers: dict[str, Callable[[], Connector]] = {}

    def register(self, name: str, maker: Callable[[], Connector]) -> None:
        if name in self._makers:
            raise ValueError(f"{name} is registered already")
        self._makers[name] = maker

    def create(self, name: str) -> Connector:
        if name not in self._makers:
            raise KeyError(f"no source {name}; there are {', '.join(sorted(self._makers))}")
        return self._makers[name]()

    def names(self) -> list[str]:
        return sorted(self._makers)


def source_parameters(filters: dict[str, Any], names: dict[str, str], default: dict[str, Any] | None = None) -> tuple[dict[str, Any], list[str]]:
    """Parameters for the source, and the names of filters that it does not know. Lists are joined by commas."""
    out, left = dict(default or {}), []
    for k, v in filters.items():
        if v in (None, "", []):
            continue
        if k in names:
            out[names[k]] = ",".join(map(str, v)) if isinstance(v, (list, tuple)) else (int(v) if isinstance(v, float) and v.is_integer() else v)
        else:
            left.append(k)
    return out, left


class _PagePartition(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class JsonPages(DataSource):
    """Pages of a REST source, saved as <path>/<page>.json: {"content": [...], "totalElements": n}.

    Options: path, pages. Columns: page, position, ident, payload. A page that cannot be read gives a row with its error
    instead of failing the read.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page int, position int, ident string, status string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonPagesReader(self.options)


class _JsonPagesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pages, self.wanted = options["path"], int(options.get("pages", "1")), {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of pages decide which are asked for; equality of status goes to the source; the rest stays with Spark."""
        low, high = 0, self.pages - 1
        for f in filters:
            column = f.attribute[0]
            if column == "page" and isinstance(f, (EqualTo, GreaterThanOrEqual)):
                low = max(low, f.value)
            if column == "page" and isinstance(f, (EqualTo, LessThanOrEqual)):
                high = min(high, f.value)
            if column == "status" and isinstance(f, (EqualTo, In)):
                self.wanted["status"] = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if column != "page" or not isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                yield f
        self.low, self.high = low, high

    def partitions(self):
        return [_PagePartition(n) for n in range(getattr(self, "low", 0), getattr(self, "high", self.pages - 1) + 1)]

    def read(self, partition):
        try:
            with open(f"{self.path}/{partition.number}.json", encoding="utf-8") as f:
                items = items_of(json.load(f))
        except (OSError, ValueError) as e:
            yield (partition.number, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for n, item in enumerate(items):
            status = item.get("lotStatus")
            if "status" not in self.wanted or status in self.wanted["status"]:
                yield (partition.number, n, str(item["id"]) if item.get("id") else None, status, json.dumps(item, ensure_ascii=False), None)


# Keys that an answer keeps its items, its totals and its pages under.
ITEM_KEYS = ("content", "items", "data", "results", "lotCards", "lots", "records")
TOTAL_KEYS = ("totalElements", "total", "totalCount", "total_count", "count")
PAGES_KEYS = ("totalPages", "total_pages", "pages", "pageCount")


def items_of(payload: Any) -> list[dict]:
    """The list of items in an answer, wherever such sources keep it; a list ends the search, an object only if it has items."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    for key in ITEM_KEYS if isinstance(payload, dict) else ():
        inner = payload.get(key)
        if isinstance(inner, list) or (isinstance(inner, dict) and items_of(inner)):
            return items_of(inner)
    return []


def count_of(payload: Any, keys: tuple[str, ...] = TOTAL_KEYS) -> int | None:
    """The first of keys that is a whole number, of an answer or of its page object."""
    while isinstance(payload, dict):
        for key in keys:
            try:
                return int(payload[key])
            except (KeyError, TypeError, ValueError):
                continue
        payload = payload.get("page")
    return None


def has_more(payload: Any, page: int, size: int, count: int) -> bool:
    """Whether pages follow page (from 1): as the answer says, else by its total, else where the page is full."""
    said = payload if isinstance(payload, dict) else {}
    if "last" in said:
        return not said["last"]
    if "hasNext" in said:
        return bool(said["hasNext"])
    total = count_of(payload)
    return page * size < total if total is not None else count >= size


def numbered(name: str, fetch: Callable[[dict[str, Any], int], Any], filters: dict[str, str] | None = None, page_size: int = 20) -> Connector:
    """A connector whose cursor is the page's number, over a source that answers (parameters, page from 1) with JSON."""

    def page(parameters: dict[str, Any], cursor: str | None) -> Page:
        number = int(cursor or 1)
        answer = fetch(parameters, number)
        rows = items_of(answer)
        return Page(rows, str(number + 1) if rows and has_more(answer, number, page_size, len(rows)) else None, count_of(answer))

    return Connector(name, page, filters or {}, page_size)


def every_page(connector: Connector, filters: dict[str, Any], cursor: str | None = None) -> Iterator[tuple[str | None, Page]]:
    """Pages with the cursors that gave them, from one on; what the source cannot filter by is left to the reader."""
    parameters, _ = source_parameters(filters, connector.filters)
    while True:
        page = connector.fetch(parameters, cursor)
        yield cursor, page
        if page.cursor is None or page.cursor == cursor:
            return
        cursor = page.cursor


def capabilities(spark: SparkSession, registry: Registry) -> DataFrame:
    """A row for each source of the registry: its page size, what it filters by itself, and how these parameters are called."""
    made = [registry.create(n) for n in registry.names()]
    return spark.createDataFrame([(x.name, x.page_size, sorted(x.filters), x.filters) for x in made], "source string, page_size int, filters array<string>, parameters map<string,string>")


def saved_pages(spark: SparkSession, path: str, stream: bool = False, per_trigger: int = 100) -> DataFrame:
    """Saved answers below path, a file each, as rows (file, payload), read by Spark from whatever store the path names.

    As a stream, the files that a checkpoint has seen are its cursor: one that is stopped and started again goes on with
    the pages that it has not given yet, and with those saved meanwhile.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger) if stream else spark.read
    return reader.schema("value string").option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def _listed(v: Column) -> Column:
    """The list of items in an answer (a variant), at the top, under one of ITEM_KEYS, or under two."""
    at = lambda path: F.try_variant_get(v, path, "array<variant>")
    held = [at("$")]
    for key in ITEM_KEYS:
        inner = [at(f"$.{key}.{k}") for k in ITEM_KEYS]
        held += [at(f"$.{key}"), F.coalesce(*[F.when(F.size(x) > 0, x) for x in inner])]
    return F.filter(F.coalesce(*held), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _parsed(pages: DataFrame) -> DataFrame:
    read = pages.withColumn("_v", F.try_parse_json("payload"))
    number = F.coalesce(*[F.try_variant_get("_v", p, "int") for p in ("$.number", "$.page.number", "$.page", "$.pageNumber")])
    total = F.coalesce(*[F.try_variant_get("_v", f"$.{p}{k}", "long") for p in ("", "page.") for k in TOTAL_KEYS])
    return read.withColumn("page", number).withColumn("total", total).withColumn("_items", _listed(F.col("_v")))


def page_items(pages: DataFrame, ident: str = "id", status: str = "lotStatus") -> DataFrame:
    """Rows (file, page, position, ident, status, payload, error) of saved_pages: an item each, as json_pages gives them.

    A page that is no JSON gives one row with its error, one without items none. All of it stays in the JVM.
    """
    read = _parsed(pages).withColumn("error", F.when(F.col("_v").isNull(), "no JSON"))
    none = F.array(F.lit(None).cast("variant"))
    rows = read.select("file", "page", "error", F.posexplode(F.when(F.col("error").isNotNull(), none).otherwise(F.col("_items"))).alias("position", "_item"))
    text = lambda key: F.try_variant_get("_item", f"$.{key}", "string")
    return rows.select("file", "page", F.when(F.col("error").isNull(), F.col("position")).alias("position"), F.nullif(text(ident), F.lit("")).alias("ident"), text(status).alias("status"), F.to_json("_item").alias("payload"), "error")


def health(pages: DataFrame, ident: str = "id") -> DataFrame:
    """One row about the pages of a source: how many there are, failed or were empty, the items and different ids they hold,
    the total that the source gives, how many of it are missing, and ok, degraded or failed."""
    read = _parsed(pages)
    by_page = read.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("_v").isNull()).alias("failed"), F.count_if(F.col("_v").isNotNull() & (F.coalesce(F.size("_items"), F.lit(0)) == 0)).alias("empty"), F.max("total").alias("total")
    )
    by_item = page_items(pages, ident).where("error IS NULL").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("ident").alias("ids"))
    state = F.when(F.col("failed") == F.col("pages"), "failed").when(F.col("failed") > 0, "degraded").otherwise("ok")
    return by_page.crossJoin(F.broadcast(by_item)).select("*", F.greatest(F.coalesce(F.col("total"), F.lit(0)) - F.col("ids"), F.lit(0)).alias("missing"), state.alias("status"))  # single rows


def register(spark: SparkSession) -> None:
    """Make json_pages known to the session, and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonPages)


def normalise(pages: DataFrame, source: str, system: str = "", base: str = "") -> DataFrame:
    """Payloads of json_pages as records; rows without an id go, the first of a repeated id stays."""
    from . import records
    from .paging import crawl

    return records.of_listings(crawl(pages.where("error IS NULL"), "ident", "page", "position"), "payload", source, system or source, base)
