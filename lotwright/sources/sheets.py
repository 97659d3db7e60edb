"""Spreadsheet exports: rows below a banner and a header, as maps of header to text."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(raw: bytes, header_row: int = 2) -> list[dict[str, str]]:
    """The rows below the header of the first sheet; of headers that occur twice the last counts."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_NS + "si")]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    table = []
    for row in sheet.iter(_NS + "row"):
        cells = {}
        for k, c in enumerate(row.iter(_NS + "c")):
            text = "".join(t.text or "" for t in c.iter(_NS + "t")) if c.get("t") == "inlineStr" else (c.findtext(_NS + "v") or "")
            cells[_column(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" else text
        table.append(cells)
    if len(table) < header_row:
        return []
    header = table[header_row - 1]
    return [{header[k]: v for k, v in row.items() if header.get(k)} for row in table[header_row:] if any(row.values())]


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def rows_of(raw: pd.Series) -> pd.Series:
    return raw.map(sheet_rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, position, cells) of every .xlsx file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.posexplode(rows_of("content")).alias("position", "cells"))


def normalise(rows: DataFrame, source: str) -> DataFrame:
    """One row a lot: external_id, prices and texts by header; repeated lots once."""
    from ..functions import extract, money

    # Headers of the export.
    cell = lambda name: F.nullif(F.trim(F.try_element_at("cells", F.lit(name))), F.lit(""))
    said = F.concat_ws(" ", cell("Описание лота"), cell("Предмет торгов"), cell("Характеристики имущества"))
    out = rows.select(
        F.concat(F.lit(source + ":"), F.concat_ws("_", cell("Номер извещения"), cell("Номер лота"))).alias("external_id"),
        cell("Предмет торгов").alias("title"),
        cell("Субъект РФ").alias("region_name"),
        cell("Местонахождение имущества").alias("address"),
        money.parse_money(cell("Начальная цена")).alias("start_price"),
        money.parse_money(cell("Размер задатка")).alias("deposit_amount"),
        F.try_element_at(extract.cadastral_numbers(said), F.lit(1)).alias("cadastral_number"),
        cell("Дата и время окончания подачи заявок").alias("application_deadline"),
    )
    return out.where(F.col("external_id") != source + ":").dropDuplicates(["external_id"])
