"""Places: regions of listings, addresses to look up, geometries and attributes of land registers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonwalk import first_non_empty
from .regions import REGIONS
from .text import col, contains_any, slug

# What an address may name so that no city is put before it, and the city that is.
KNOWN_PLACES = ("ярослав", "рыбинск", "архангельск", "москва", "санкт-петербург", "ленинградская")
DEFAULT_CITY = "Ярославль"
NO_REGION = "Регион не определён"
# Spellings of one region in queries, and the spelling that a run is started under.
QUERY_ALIASES = {"yaroslavl": ("yaroslavl", "76", "84"), "76": ("76", "yaroslavl", "84"), "84": ("84", "76", "yaroslavl")}
SYNC_ALIASES = {"76": "yaroslavl", "84": "yaroslavl"}
DEFAULT_REGION = "yaroslavl"
# Attributes of a land register and the keys that may hold them.
REGISTER_KEYS = {
    "Вид объекта недвижимости": ("categoryName", "category_name", "objectType", "typeName", "type"),
    "Кадастровый номер": ("cad_num", "cadNum", "cadastralNumber", "cn", "label"),
    "Адрес": ("address", "readableAddress", "location", "addr"),
    "Наименование": ("name", "label", "descr"),
    "Назначение": ("purpose", "util_by_doc", "assignation"),
    "Площадь общая": ("area", "area_value", "readableArea"),
    "Статус": ("status", "state", "readableStatus"),
    "Кадастровая стоимость": ("cad_cost", "cost", "readableCadCost"),
    "Категория НСПД": ("category", "categoryId"),
}


def region_query_values(region: str | None) -> tuple[str, ...]:
    """All spellings that rows of a region may be stored under; no region: the default one."""
    key = (region or "").strip() or DEFAULT_REGION
    return QUERY_ALIASES.get(key, (key,))


def region_sync_name(region: str | None) -> str:
    key = (region or "").strip() or DEFAULT_REGION
    return SYNC_ALIASES.get(key, key)


def _blank(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def region_label(name: Column | str, cadastral: Column | str, *texts: Column | str) -> Column:
    """The given name, else that of the cadastral prefix, else the longest name that a text holds, else NO_REGION."""
    by_code = F.create_map(*[F.lit(x) for code, full, *_ in REGIONS for x in (code, full)])
    prefix = F.lpad(F.nullif(F.regexp_extract(_blank(cadastral), r"^(\d{1,2}):", 1), F.lit("")), 2, "0")
    low = F.lower(F.concat_ws(" ", *[F.nullif(_blank(t), F.lit("")) for t in texts]))
    longest = F.array(*[F.lit(full) for full in sorted((r[1] for r in REGIONS), key=lambda x: (-len(x), x))])
    named = F.get(F.filter(longest, lambda x: low.contains(F.lower(x))), F.lit(0))
    return F.coalesce(F.trim(F.nullif(_blank(name), F.lit(""))), F.try_element_at(by_code, prefix), named, F.lit(NO_REGION))


def in_subject(code: str, name: str, cadastral: Column | str, *texts: Column | str) -> Column:
    """Whether a row is of a region: by name or its slug in the texts, or by the cadastral prefix."""
    low = F.lower(F.concat_ws(" ", *[F.nullif(_blank(t), F.lit("")) for t in texts]))
    short = slug(F.lit(name))
    prefix = F.lpad(F.substring_index(_blank(cadastral), ":", 1), 2, "0")
    return low.contains(name.lower()) | (F.length(short) > 0) & low.contains(short) | (prefix == code.zfill(2))


def lookup_query(c: Column | str) -> Column:
    """An identifier or an address with a known place as it is, other addresses with the default city before them."""
    q = _blank(c)
    known = q.rlike(r"^\d{2}:\d{2}:\d{6,7}:\d+$") | contains_any(F.lower(q), KNOWN_PLACES)
    return F.when((q == "") | known, q).otherwise(F.concat(F.lit(f"{DEFAULT_CITY}, "), q))


def geojson(c: Column | str) -> Column:
    """A JSON geometry's type and coordinates as JSON; null without either."""
    kind, points = F.get_json_object(col(c), "$.type"), F.get_json_object(col(c), "$.coordinates")
    whole = (F.coalesce(kind, F.lit("")) != "") & ~F.coalesce(points, F.lit("")).isin("", "[]", "{}")
    return F.when(whole, F.concat(F.lit('{"type":'), F.to_json(F.array(kind)).substr(F.lit(2), F.length(F.to_json(F.array(kind))) - 2), F.lit(',"coordinates":'), points, F.lit("}")))


def register_attributes(c: Column | str, number: Column | str) -> Column:
    """A map of the named attributes from a register's JSON: the first key that is not empty, of the object, then of its options."""
    out = []
    for name, keys in REGISTER_KEYS.items():
        value = first_non_empty(c, *keys, *[f"options.{k}" for k in keys])
        out += [F.lit(name), F.coalesce(value, col(number)) if name == "Кадастровый номер" else value]
    return F.create_map(*out)


def unresolved(*addresses: Column | str) -> Column:
    """The decision on a place that was not found: no coordinates are made up, and a check is asked for."""
    none = F.lit(None)
    return F.struct(
        F.lit("fallback").alias("geo_source"), F.lit("unresolved").alias("geo_method"), F.lit("none").alias("geo_confidence"), none.cast("double").alias("centroid_lat"), none.cast("double").alias("centroid_lon"),
        F.lit(True).alias("needs_geo_check"), F.coalesce(*[F.nullif(_blank(a), F.lit("")) for a in addresses], F.lit("")).alias("address_used"),
    )
