"""JSON payloads: first non-empty key, deep search, image addresses, repair."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

# Keys that hold pictures, and keys of an object that name it.
IMAGE_KEYS = ("photos", "images", "gallery", "pictures", "photo", "image", "thumbnail", "photo_url", "image_url", "thumb_url", "url", "src")
NAMING_KEYS = ("name", "label", "value", "title", "fullName", "address")
IMAGE_DEPTH = 4


def first_non_empty(c: Column | str, *keys: str) -> Column:
    """The first key of a JSON object whose value is not null, blank, [] or {}."""
    out = []
    for k in keys:
        v = F.get_json_object(col(c), "$." + k)
        out.append(F.when(~v.isin("", "[]", "{}"), v))
    return F.coalesce(*out)


def _parse(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def image_urls_of(payload: Any, depth: int = 0, named: bool = False) -> list[str]:
    if depth > IMAGE_DEPTH:
        return []
    if isinstance(payload, str):
        url = "https:" + payload if payload.startswith("//") else payload
        return [url] if named and re.match(r"https?://", url) else []
    if isinstance(payload, list):
        return [u for x in payload for u in image_urls_of(x, depth + 1, named)]
    if isinstance(payload, dict):
        return [u for k, v in payload.items() if k.lower() in IMAGE_KEYS or isinstance(v, (list, dict)) for u in image_urls_of(v, depth + 1, k.lower() in IMAGE_KEYS)]
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def image_urls(payloads: pd.Series) -> pd.Series:
    """Addresses of pictures in JSON, to a depth of four, each once, in order; only http and https."""
    return payloads.map(lambda t: list(dict.fromkeys(image_urls_of(_parse(t)))))


_EMPTY = (None, "", [], {})


def _get(payload: Any, key: str) -> Any:
    """A key of an object, whatever its case."""
    return next((v for k, v in payload.items() if k.lower() == key.lower()), None) if isinstance(payload, dict) else None


def first_values(payload: Any) -> dict[str, Any]:
    """The first value that is not empty under each key in lower case: an object's own first, then those below, to the bottom."""
    out: dict[str, Any] = {}
    stack = [payload]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            own: set[str] = set()
            for k, v in at.items():
                low = k.lower()
                if low not in own and low not in out and v not in _EMPTY:
                    out[low] = v
                own.add(low)
        stack.extend(reversed(list(at.values()) if isinstance(at, dict) else at if isinstance(at, list) else []))
    return out


def deep_find(payload: Any, path: str, values: dict[str, Any] | None = None) -> Any:
    """A dotted path is followed from the top; a key is looked for at any depth, in values where first_values is known."""
    if "." in path:
        for key in path.split("."):
            payload = _get(payload, key)
        return payload
    return (first_values(payload) if values is None else values).get(path.lower())


def pick(payload: Any, *keys: str, values: dict[str, Any] | None = None) -> str | None:
    """The first key's value as text: an object by what names it at any depth, or as JSON; a list by its parts."""
    values = first_values(payload) if values is None else values
    for k in keys:
        v = deep_find(payload, k, values)
        if isinstance(v, dict):
            v = next((named for n in NAMING_KEYS if (named := pick(v, n)) is not None), v)
        if isinstance(v, list):
            v = ", ".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in v if x not in _EMPTY)
        if v not in _EMPTY:
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return None


def deep_pick(c: Column | str, *keys: str) -> Column:
    @F.pandas_udf(T.StringType())
    def walk(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda t: pick(_parse(t), *keys))

    return walk(col(c))


def repair_object(text: str | None) -> str | None:
    """A JSON object out of a model's answer: without fence, from brace to brace, without trailing commas, keys quoted."""
    if not text:
        return None
    bare = re.sub(r"^\s*```(?:json)?|```\s*$", "", text.strip())
    cut = bare[bare.find("{") : bare.rfind("}") + 1]
    fixed = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', re.sub(r",(\s*[}\]])", r"\1", cut))
    for candidate in (bare, cut, fixed):
        if isinstance(_parse(candidate), dict):
            return json.dumps(_parse(candidate), ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(T.StringType())
def repaired_object(texts: pd.Series) -> pd.Series:
    return texts.map(repair_object)


def map_difference(a: Column, b: Column) -> Column:
    """A map of the keys whose values differ, to a struct (before, after); a key that one lacks is null there."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))
