"""The registry as a table to hand out: labelled columns, whole numbers, shown dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates

# The columns of the export, in their order, and what they hold.
_WHOLE, _AS_IS = "whole", "as is"
COLUMNS = (
    ("Код", "external_id", _AS_IS), ("Название", "title", _AS_IS), ("Описание", "description", _AS_IS), ("Категория", "category", "category"), ("Регион", "region_slug", _AS_IS),
    ("Адрес", "address", _AS_IS), ("Кадастровый номер", "cadastral_number", _AS_IS), ("Все кадастровые номера", "cadastral_numbers", "list"), ("Текущая цена", "current_price", _WHOLE),
    ("Рыночная цена", "market_price", _WHOLE), ("Дисконт %", "discount_percent", _WHOLE), ("Риск (1-10)", "risk_score", _WHOLE), ("Рейтинг", "rating", _WHOLE),
    ("Статус торгов", "auction_status", "status"), ("Ссылка", "lot_url", _AS_IS), ("Площадь здания/помещения, м²", "total_area_gba", _AS_IS), ("Площадь участка, м²", "land_area", _AS_IS),
    ("Площадь участка, сот.", "land_area", "sotka"), ("Этажность", "floors", _WHOLE), ("Юридический статус", "legal_status", _AS_IS), ("Статус проверки", "review_status", _AS_IS), ("Обновление", "last_update", "moment"),
)


def whole(c: Column | str) -> Column:
    """A number without its fraction; null where it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double").try_cast("long")


def registry_table(lots: DataFrame) -> DataFrame:
    """lots as COLUMNS; a column that lots lacks is null. The rows' order is left to the caller."""
    made = {
        _AS_IS: F.col,
        _WHOLE: whole,
        "category": lambda c: classify.label(c, classify.CATEGORY_TITLES),
        "status": lambda c: classify.label(c, classify.STATUS_TITLES),
        "list": lambda c: F.array_join(c, ", "),
        "sotka": lambda c: F.round(F.nullif(F.col(c), F.lit(0)) / 100, 2),
        "moment": dates.display,
    }
    return lots.select(*[(made[how](c) if c in lots.columns else F.lit(None).cast("string")).alias(header) for header, c, how in COLUMNS])


def write_csv(lots: DataFrame, path: str) -> None:
    """Write the table as CSV with headers, a file a partition, so that no task holds it whole."""
    registry_table(lots).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
