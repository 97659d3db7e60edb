"""Distances, projections, viewports and address candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

EARTH_KM = 6371.0
MERCATOR_RADIUS = 6378137.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator_to_degrees(x: Column, y: Column) -> Column:
    """A struct (lon, lat); coordinates that already are degrees stay."""
    outside = (F.abs(x) > 180) | (F.abs(y) > 90)
    lon, lat = F.degrees(x / MERCATOR_RADIUS), F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS)))
    return F.struct(F.when(outside, lon).otherwise(x).alias("lon"), F.when(outside, lat).otherwise(y).alias("lat"))


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """A box whose west is greater than its east spans the antimeridian."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def ring_centre(ring: Column) -> Column:
    """The mean of the points of array<array<double>> as a struct (lat, lon); null if empty."""
    mean = lambda i: F.aggregate(F.transform(ring, lambda p: p[i]), F.lit(0.0), lambda a, v: a + v) / F.size(ring)
    return F.when(F.size(ring) > 0, F.struct(mean(1).alias("lat"), mean(0).alias("lon")))


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def shape_centre(geometry: Column | str) -> Column:
    """The mean of all points of a GeoJSON geometry, however deep its coordinates are nested, as a struct (lat, lon).

    A point is an array that begins with two numbers; null if there is none. Rings' last points count as they stand.
    """
    held = F.get_json_object(F.col(geometry) if isinstance(geometry, str) else geometry, "$.coordinates")
    points = F.regexp_extract_all(held, F.lit(rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}"), 0)
    ring = F.transform(points, lambda p: F.transform(F.split(F.translate(p, "[ ", ""), ","), lambda n: n.cast("double")))
    return ring_centre(ring)


def padded_box(west: float, south: float, east: float, north: float, zoom: int = 0, share: float = 0.15, least: float = 0.02) -> tuple[float, float, float, float]:
    """A viewport widened on all sides and rounded by its zoom, so that small moves ask for the same box; never beyond the globe."""
    dx, dy = max((east - west) * share, least), max((north - south) * share, least)
    digits = 4 if zoom >= 16 else 3 if zoom >= 10 else 2
    return max(-180.0, round(west - dx, digits)), max(-90.0, round(south - dy, digits)), min(180.0, round(east + dx, digits)), min(90.0, round(north + dy, digits))


def same_point(lat: Column, lon: Column) -> Column:
    return F.struct(F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


# What is left out of addresses, their short forms and what a gazetteer calls them, in this order.
ADDRESS_FORMS = (
    (r"\.{3,}$", ""),
    (r",?\s*(?:с|вместе\s+с)\s+земельн(?:ым|ого)\s+участк(?:ом|а).*$", ""),
    (r",\s*с\.\s*п\.\s*[^,]+", ""),
    (r"(?:м\.\s*)?р-н\s+([^,]*[^,\s])\s*", "$1 муниципальный округ"),
    (r"([^,\s][^,]*?)\s+(?:р-н|район)(?=,|$)", "$1 муниципальный округ"),
    (r"\bПереславский муниципальный округ\b", "Переславль-Залесский муниципальный округ"),
    (r"\bобл\.(?=\s|,|$)", "область"),
    (r"\bг\.(?=\s)", "город "),
    (r"\bп\.(?=\s)", "поселок "),
    (r"\bс\.(?=\s)", "село "),
    (r"\bд\.(?=\s)", "дом "),
    (r"\bул\.(?=\s)", "улица "),
    (r"\s+", " "),
)
_ANY_CASE = "(?iuU)"
REGION_PART, DISTRICT_PART = r"област", r"муниципальн|район"
LOCALITY_KINDS = r"(?:город|село|поселок|деревня|рабочий поселок)"
LOCALITY_PART, STREET_PART, HOUSE_PART = rf"\b{LOCALITY_KINDS}\b", r"\b(?:улица|проспект|шоссе|переулок)\b", r"\bдом\s*\d"


def address_candidates(address: Column | str, region: Column | str | None = None, title: Column | str | None = None) -> Column:
    """Up to four spellings to look an address up by: rewritten whole, then by its locality with street, district or region.

    A blank address is looked for in the title; no address gives an empty array. Spellings that differ in case count once.
    """
    from .extract import address as address_in

    text = F.trim(F.coalesce(col(address), F.lit("")))
    if title is not None:
        text = F.when(text == "", F.coalesce(address_in(title), F.lit(""))).otherwise(text)
    for pattern, form in ADDRESS_FORMS:
        text = F.regexp_replace(text, _ANY_CASE + pattern, form)
    text = F.regexp_replace(text, r"^[ ,.;]+|[ ,.;]+$", "")
    own = F.coalesce(col(region), F.lit("")) if region is not None else F.lit("")
    whole = let(text, lambda t: F.when((t != "") & (own != "") & ~F.contains(F.lower(t), F.lower(own)), F.concat(t, F.lit(", "), own)).otherwise(t))
    part = lambda parts, pattern: F.get(F.filter(parts, lambda p: p.rlike(_ANY_CASE + pattern)), F.lit(0))
    bare = lambda c, pattern: F.nullif(F.regexp_replace(c, _ANY_CASE + pattern, ""), F.lit(""))
    joined = lambda *of: F.concat_ws(", ", *of)

    def named(parts: Column) -> Column:
        return F.struct(
            bare(part(parts, LOCALITY_PART), rf"^{LOCALITY_KINDS}\s+").alias("place"),
            F.coalesce(part(parts, REGION_PART), F.nullif(own, F.lit(""))).alias("region"),
            part(parts, DISTRICT_PART).alias("district"),
            part(parts, STREET_PART).alias("street"),
            bare(part(parts, HOUSE_PART), r"^дом\s*").alias("house"),
        )

    def spellings(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, ","), lambda p: F.regexp_replace(p, r"^[ .;]+|[ .;]+$", "")), lambda p: p != "")
        every = let(
            let(parts, named),
            lambda n: F.array(
                F.nullif(t, F.lit("")),
                F.when(n["street"].isNotNull() & n["place"].isNotNull(), joined(n["house"], n["street"], n["place"], n["district"], n["region"])),
                F.when(n["place"].isNotNull() & n["district"].isNotNull(), joined(n["place"], n["district"], n["region"])),
                F.when(n["place"].isNotNull() & n["region"].isNotNull(), joined(n["place"], n["region"])),
            ),
        )
        return F.filter(every, lambda x: x.isNotNull())

    return let(let(whole, spellings), lambda given: F.filter(given, lambda x, i: F.array_position(F.transform(given, F.lower), F.lower(x)) == i + 1))


def candidate_score(query: Column, name: Column) -> Column:
    """Shared seven-letter stems of the words of two addresses."""
    stems = lambda t: F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower(t), F.lit("[0-9a-zа-яё]+"), 0), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, 7)))
    return F.size(F.array_intersect(stems(query), stems(name)))
