"""Dates in the formats that listings use. Bad input is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Formats tried in this order after ISO, and month names.
FORMATS = ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"


def _local(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse(c: Column | str, keep_zone: bool = True) -> Column:
    """ISO, with its zone taken to UTC (or dropped), or one of FORMATS; a session in UTC is assumed."""
    text = F.trim(col(c))
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = F.when(text.rlike(_ISO + r"(Z|[+-]\d{2}:?\d{2})?$"), (text if keep_zone else bare).try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(iso, _local(F.substring(text, 1, 19), FORMATS))


def parse_month_name(c: Column | str) -> Column:
    """Day, Russian month name, year; a time after a comma or blank may follow."""
    text = F.lower(F.trim(col(c)))
    for n, name in enumerate(MONTHS, 1):
        text = F.replace(text, F.lit(name), F.lit(f"{n:02d}"))
    part = F.regexp_extract(text, r"(\d{1,2}) (\d{2}) (\d{4})", 0)
    clock = F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1)
    return F.try_to_timestamp(F.concat(part, F.lit(" "), F.when(clock == "", "00:00").otherwise(clock)), F.lit("d MM yyyy H:mm")).cast("timestamp_ntz")


def display(c: Column | str) -> Column:
    return F.date_format(col(c), "dd.MM.yyyy HH:mm")


def sort_key(c: Column | str) -> Column:
    """What cannot be read sorts before all dates."""
    return F.coalesce(parse(c, keep_zone=False), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def stuck(started: Column, requested: Column, as_of: Column, minutes: int = 30) -> Column:
    return F.coalesce(as_of.cast("timestamp_ntz") - F.coalesce(started, requested) > F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
