"""Regions: normal keys of names, codes and the directory as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col

# The two-digit code of each subject, its name and its other spellings.
REGIONS = (
    ("01", "Республика Адыгея", "Адыгея", "Респ Адыгея"),
    ("02", "Республика Башкортостан", "Башкортостан", "Респ Башкортостан"),
    ("03", "Республика Бурятия", "Бурятия", "Респ Бурятия"),
    ("04", "Республика Алтай", "Респ Алтай"),
    ("05", "Республика Дагестан", "Дагестан", "Респ Дагестан"),
    ("06", "Республика Ингушетия", "Ингушетия", "Респ Ингушетия"),
    ("07", "Кабардино-Балкарская Республика", "Кабардино-Балкария", "КБР"),
    ("08", "Республика Калмыкия", "Калмыкия", "Респ Калмыкия"),
    ("09", "Карачаево-Черкесская Республика", "Карачаево-Черкесия", "КЧР"),
    ("10", "Республика Карелия", "Карелия", "Респ Карелия"),
    ("11", "Республика Коми", "Коми", "Респ Коми"),
    ("12", "Республика Марий Эл", "Марий Эл", "Респ Марий Эл"),
    ("13", "Республика Мордовия", "Мордовия", "Респ Мордовия"),
    ("14", "Республика Саха (Якутия)", "Якутия", "Республика Саха", "Саха Якутия"),
    ("15", "Республика Северная Осетия-Алания", "Северная Осетия", "Северная Осетия-Алания"),
    ("16", "Республика Татарстан", "Татарстан", "Респ Татарстан"),
    ("17", "Республика Тыва", "Тыва", "Тува", "Республика Тува"),
    ("18", "Удмуртская Республика", "Удмуртия"),
    ("19", "Республика Хакасия", "Хакасия", "Респ Хакасия"),
    ("20", "Чеченская Республика", "Чечня"),
    ("21", "Чувашская Республика", "Чувашия", "Чувашская Республика — Чувашия"),
    ("22", "Алтайский край"),
    ("23", "Краснодарский край"),
    ("24", "Красноярский край"),
    ("25", "Приморский край"),
    ("26", "Ставропольский край"),
    ("27", "Хабаровский край"),
    ("28", "Амурская область", "Амурская обл"),
    ("29", "Архангельская область", "Архангельская обл"),
    ("30", "Астраханская область", "Астраханская обл"),
    ("31", "Белгородская область", "Белгородская обл"),
    ("32", "Брянская область", "Брянская обл"),
    ("33", "Владимирская область", "Владимирская обл"),
    ("34", "Волгоградская область", "Волгоградская обл"),
    ("35", "Вологодская область", "Вологодская обл"),
    ("36", "Воронежская область", "Воронежская обл"),
    ("37", "Ивановская область", "Ивановская обл"),
    ("38", "Иркутская область", "Иркутская обл"),
    ("39", "Калининградская область", "Калининградская обл"),
    ("40", "Калужская область", "Калужская обл"),
    ("41", "Камчатский край"),
    ("42", "Кемеровская область", "Кемеровская обл", "Кузбасс", "Кемеровская область - Кузбасс"),
    ("43", "Кировская область", "Кировская обл"),
    ("44", "Костромская область", "Костромская обл"),
    ("45", "Курганская область", "Курганская обл"),
    ("46", "Курская область", "Курская обл"),
    ("47", "Ленинградская область", "Ленинградская обл"),
    ("48", "Липецкая область", "Липецкая обл"),
    ("49", "Магаданская область", "Магаданская обл"),
    ("50", "Московская область", "Московская обл", "Подмосковье"),
    ("51", "Мурманская область", "Мурманская обл"),
    ("52", "Нижегородская область", "Нижегородская обл"),
    ("53", "Новгородская область", "Новгородская обл"),
    ("54", "Новосибирская область", "Новосибирская обл"),
    ("55", "Омская область", "Омская обл"),
    ("56", "Оренбургская область", "Оренбургская обл"),
    ("57", "Орловская область", "Орловская обл"),
    ("58", "Пензенская область", "Пензенская обл"),
    ("59", "Пермский край"),
    ("60", "Псковская область", "Псковская обл"),
    ("61", "Ростовская область", "Ростовская обл"),
    ("62", "Рязанская область", "Рязанская обл"),
    ("63", "Самарская область", "Самарская обл"),
    ("64", "Саратовская область", "Саратовская обл"),
    ("65", "Сахалинская область", "Сахалинская обл"),
    ("66", "Свердловская область", "Свердловская обл"),
    ("67", "Смоленская область", "Смоленская обл"),
    ("68", "Тамбовская область", "Тамбовская обл"),
    ("69", "Тверская область", "Тверская обл"),
    ("70", "Томская область", "Томская обл"),
    ("71", "Тульская область", "Тульская обл"),
    ("72", "Тюменская область", "Тюменская обл"),
    ("73", "Ульяновская область", "Ульяновская обл"),
    ("74", "Челябинская область", "Челябинская обл"),
    ("75", "Забайкальский край"),
    ("76", "Ярославская область", "Ярославская обл"),
    ("77", "г. Москва", "Москва", "г Москва", "город Москва"),
    ("78", "г. Санкт-Петербург", "Санкт-Петербург", "СПб", "г Санкт-Петербург"),
    ("79", "Еврейская автономная область", "ЕАО", "Еврейская автономная обл"),
    ("80", "Донецкая Народная Республика", "ДНР", "Донецкая народная Республика"),
    ("81", "Луганская народная Республика", "ЛНР", "Луганская Народная Республика"),
    ("82", "Республика Крым", "Крым", "Респ Крым"),
    ("83", "Ненецкий автономный округ", "НАО"),
    ("84", "Херсонская область", "Херсонская обл"),
    ("85", "Запорожская область", "Запорожская обл"),
    ("86", "Ханты-Мансийский автономный округ", "ХМАО", "Ханты-Мансийский АО", "Югра"),
    ("87", "Чукотский автономный округ", "ЧАО", "Чукотский АО"),
    ("89", "Ямало-Ненецкий автономный округ", "ЯНАО", "Ямало-Ненецкий АО"),
    ("92", "г. Севастополь", "Севастополь", "г Севастополь"),
)


def directory() -> list[tuple[str, str, list[str]]]:
    """Code, name and all spellings of every region."""
    return [(code, name, [name, *more]) for code, name, *more in REGIONS]


def key(c: Column | str) -> Column:
    low = F.translate(F.lower(col(c)), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[.(),—–-]+", " "), r"\s+", " "))


def aliases(spark: SparkSession) -> DataFrame:
    """Rows (key, code, name) for every spelling and code: a table of a few hundred rows whatever the data."""
    rows = [(s, code, name) for code, name, spellings in directory() for s in [*spellings, code, code.lstrip("0")]]
    return spark.createDataFrame(rows, "spelling string, code string, name string").select(key("spelling").alias("key"), "code", "name").dropDuplicates(["key"])


def with_region(df: DataFrame, column: str) -> DataFrame:
    """df with region_code and region_name, null where the spelling is not known."""
    found = aliases(df.sparkSession).select(F.col("key").alias("_key"), F.col("code").alias("region_code"), F.col("name").alias("region_name"))
    return df.withColumn("_key", key(column)).join(F.broadcast(found), "_key", "left").drop("_key")


def label(code: Column | str, name: Column | str) -> Column:
    return F.concat_ws(" — ", col(code), col(name))
