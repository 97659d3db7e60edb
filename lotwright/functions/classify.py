"""Ordered classifiers: category, status, sale predicate. The first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col, contains_any

# What the text holds, and the category it then has; all lists of a rule must be met.
CATEGORY_RULES = (
    ("car", (("автомоб", "vin", "грузов", "транспорт", "авто", "прицеп", "легков"),)),
    ("apartment", (("квартир",),)),
    ("commercial_room", (("помещени",),)),
    ("commercial_building_with_land", (("нежилое здание", "здание", "склад", "цех"), ("земельн", "участ"))),
    ("commercial_building", (("нежилое здание", "здание", "склад", "цех"),)),
    ("house", (("жилой дом", "дом жилой", "коттедж"),)),
    ("land", (("земельн", "участ"),)),
    ("parking", (("машино-место", "гараж"),)),
    ("unfinished", (("незаверш",),)),
    ("complex", (("комплекс",),)),
    ("receivable", (("дебитор", "право требования"),)),
    ("real_estate", (("недвиж",),)),
)
STATUS_RULES = (
    ("closed", ("closed", "completed", "finished", "заверш", "закрыт", "несостоя")),
    ("scheduled", ("scheduled", "pending", "приём", "прием", "ожида")),
    ("active", ("active", "published", "open", "опублик", "идут торги")),
)
STATUS_CODES = (
    ("active", ("published", "applications_submission", "applications_acceptance")),
    ("scheduled", ("bidding", "determining_winner")),
    ("closed", ("completed", "canceled", "cancelled", "failed", "annulled", "archive")),
)
CATALOGUE_STATUS_RULES = (
    ("active", ("опублик", "прием", "приём", "заяв")),
    ("closed", ("проведен", "заверш", "состоял", "отмен", "аннулир")),
    ("scheduled", ("торг", "ожида", "назнач")),
)
DECISION_RULES = (
    ("closed", ("заверш", "архив", "состоял", "продан")),
    ("active", ("опублик", "прием заявок", "приём заявок", "осталось", "до окончания")),
    ("scheduled", ("начало торгов",)),
)
REAL_ESTATE_CATEGORIES = (
    "land", "real_estate", "apartment", "house", "commercial", "commercial_room", "commercial_building",
    "commercial_building_with_land", "parking", "unfinished", "complex", "office", "retail", "living",
)
MOVABLE_CATEGORIES = ("car", "vehicle", "transport", "movable")
REAL_ESTATE_TERMS = (
    "недвиж", "земел", "участ", "здан", "помещен", "квартир", "жилой дом", "домовлад", "гараж", "машино-мест", "машиномест",
    "сооружен", "имущественный комплекс", "кадастров",
)
MOVABLE_TERMS = ("автомобил", "транспортное средство", "движимое имущество")
RENTAL_TERMS = ("аренда", "аренды", "аренду", "арендный", "арендатор", "субаренда", "право заключения договора аренды", "договор найма", "право пользования")
SHARE_PATTERN = r"(?iuU)\bдол(?:я|и|ю|ей|е)\b"
HERITAGE_PATTERN = r"(?iuU)\b(?:объект(?:ом|а|ы)?\s+культурного\s+наследия|культурного\s+наследия|выявленн(?:ый|ого|ому)\s+объект|ансамбл(?:ь|я|ем|и)|памятник(?:ом|а|и)?\s+(?:архитектуры|истории)|ОКН)\b"
STATUS_LABELS = {"active": "Активен", "scheduled": "Запланирован", "closed": "Завершён", "unknown": "Неизвестен"}


def first_rule(text: Column, rules: tuple, otherwise: Column) -> Column:
    """The name of the first rule whose words occur in text."""
    out = None
    for name, words in rules:
        test = contains_any(text, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def category(title: Column | str, description: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit(""))))
    out = None
    for name, lists in CATEGORY_RULES:
        test = F.lit(True)
        for words in lists:
            test = test & contains_any(text, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def category_of_source(code: Column | str, codes: dict[str, str], name: Column | str, title: Column | str, description: Column | str) -> Column:
    """A source's own code if it is known, else words of its category's name, else the title's rules."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]) if codes else F.create_map(F.lit(""), F.lit(""))
    low = F.lower(F.coalesce(col(name), F.lit("")))
    named = (
        F.when(low.contains("транспорт"), "transport")
        .when(low.contains("земель") & low.contains("здани"), "commercial_building_with_land")
        .when(low.contains("земель"), "land")
        .when(low.contains("недвиж"), "real_estate")
    )
    return F.coalesce(F.try_element_at(table, col(code).cast("string")), named, category(title, description))


def status(c: Column | str) -> Column:
    """Blank: unknown; no rule: the text itself without blanks at its ends."""
    bare = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(bare == "", "unknown").otherwise(first_rule(F.lower(bare), STATUS_RULES, bare))


def catalogue_status(c: Column | str) -> Column:
    text = F.lower(clean(c))
    return F.when(text == "", "unknown").otherwise(first_rule(text, STATUS_CODES + CATALOGUE_STATUS_RULES, F.lit("unknown")))


def status_decision(raw_status: Column | str, captions: Column | str, fallback: Column | str | None = None) -> Column:
    """A struct (final_status, confidence, source, trace_reason) from a raw status and an array of date captions."""
    given = F.coalesce(F.nullif(col(raw_status), F.lit("")), col(fallback) if fallback is not None else F.lit(None).cast("string"), F.lit(""))
    text = F.lower(F.concat_ws(" ", given, F.array_join(F.coalesce(col(captions), F.array().cast("array<string>")), " ")))
    return F.struct(
        first_rule(text, DECISION_RULES, F.lit("unknown")).alias("final_status"),
        F.lit("medium").alias("confidence"),
        F.lit("primary").alias("source"),
        F.concat(F.lit("from status and dates: "), F.substring(text, 1, 300)).alias("trace_reason"),
    )


def kept_status(decision: Column, existing: Column | str) -> Column:
    """A status_decision for a row that has a status: a known one is kept where the decision is unknown, and the trace says so."""
    had = F.nullif(F.coalesce(col(existing), F.lit("")), F.lit(""))
    keep = (decision["final_status"] == "unknown") & had.isNotNull() & (had != "unknown")
    traced = F.concat(decision["trace_reason"], F.lit(" | Existing normalized status was preserved."))
    return decision.withField("final_status", F.when(keep, had).otherwise(decision["final_status"])).withField("trace_reason", F.when(keep, traced).otherwise(decision["trace_reason"]))


def label(c: Column | str, labels: dict[str, str]) -> Column:
    """A value's label; a value without one stands for itself."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(c)), col(c))


def is_real_estate(category: Column | str, text: Column | str) -> Column:
    """By category where it decides, else by terms of the text."""
    kind, low = F.lower(F.coalesce(col(category), F.lit(""))), F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(kind.isin(*REAL_ESTATE_CATEGORIES), True).when(kind.isin(*MOVABLE_CATEGORIES), False).otherwise(contains_any(low, REAL_ESTATE_TERMS))


def is_share_or_heritage(text: Column | str) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return t.rlike(SHARE_PATTERN) | t.rlike(HERITAGE_PATTERN)


def is_sale_real_estate(category: Column | str, text: Column | str) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return is_real_estate(category, text) & ~contains_any(low, RENTAL_TERMS) & ~is_share_or_heritage(text)


def ended(archived: Column, closed_at: Column, status: Column, auction_at: Column, as_of: Column) -> Column:
    return F.coalesce(archived, F.lit(False)) | closed_at.isNotNull() | F.coalesce(status.isin("closed", "archived"), F.lit(False)) | F.coalesce(auction_at <= as_of, F.lit(False))


# Labels of statuses and categories, and captions that tell a status in this order.
STATUS_TITLES = {"active": "Активен", "closed": "Завершен", "pending": "Ожидается", "scheduled": "Запланирован", "unknown": "Неизвестно"}
CATEGORY_TITLES = {
    "apartment": "Квартира", "house": "Жилой дом", "commercial": "Коммерческая недв.", "commercial_room": "Нежилое помещение", "commercial_building": "Нежилое здание",
    "commercial_building_with_land": "Нежилое здание + ЗУ", "complex": "Имущ. комплекс", "office": "Офис", "retail": "Торговое", "land": "Земельный участок", "car": "Автомобиль",
    "transport": "Транспорт", "vehicle": "Спецтехника", "equipment": "Оборудование", "parking": "Парковка", "unfinished": "Недострой", "receivable": "Права требования", "real_estate": "Недвижимость", "other": "Прочее",
}
CAPTION_RULES = (
    ("active", ("прием заявок до", "приём заявок до", "осталось", "до окончания")),
    ("scheduled", ("начало торгов",)),
    ("closed", ("заверш", "не состоял", "состоял", "прием заявок завершен", "приём заявок завершен")),
)


def status_of_captions(captions: Column | str, icon: Column | str) -> Column:
    """By an array of date captions, else by the class of the status icon."""
    text = F.lower(F.array_join(F.coalesce(col(captions), F.array().cast("array<string>")), " "))
    return first_rule(text, CAPTION_RULES, F.when(F.lower(F.coalesce(col(icon), F.lit(""))).contains("green"), "active").otherwise("unknown"))
