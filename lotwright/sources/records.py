"""Answers of sources as records of one shape: every field of a listing, typed, with what the source did not say as null."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, dates, extract, jsonwalk, money, text

# The fields of a record and their types, in their order.
RECORD = (
    "external_id string, source string, source_system string, title string, description string, category string, region_slug string, region_name string, address string, "
    "cadastral_number string, vin string, area double, start_price double, current_price double, auction_status string, lot_url string, source_url string, detail_level string, "
    "raw_data string, published_at timestamp_ntz, platform_name string, platform_code string, procedure_number string, notice_number string, efresb_message_number string, "
    "debtor_name string, organizer_name string, auction_manager_name string, bankruptcy_case_number string, deposit_amount double, deposit_percent double, deposit_payment_details string, "
    "deposit_deadline timestamp_ntz, application_deadline timestamp_ntz, auction_at timestamp_ntz, auction_step_amount double, auction_step_percent double, auction_type string, "
    "public_offer_schedule string, next_interval_price double, next_price_reduction_at timestamp_ntz, document_completeness string, inspection_procedure string, organizer_contact string, "
    "object_name string, property_type string, total_area_gba double, gla double, land_area double, floors int, year_built int, occupancy_rate double, anchor_tenants string, "
    "monthly_fixed_rent double, monthly_variable_rent double, monthly_other_income double, monthly_opex double, noi_annual double, legal_status string, encumbrances string, "
    "land_risk_flag boolean, technical_condition string, power_kw double, parking_spaces int"
)
# Keys that a listing's answer may keep a field under, tried in this order.
LISTING_KEYS = {
    "id": ("id", "lotCardId", "lotId", "lotIdentifier", "lotGuid", "commonId"),
    "notice": ("noticeNumber", "noticeNo", "noticeId", "noticeRegistryNumber"),
    "lot": ("lotNumber", "lotNum", "number", "lotNo"),
    "title": ("lotName", "name", "title", "lotTitle", "subject", "objectName", "noticeName"),
    "description": ("lotDescription", "description", "fullDescription", "objectInfo", "assetDescription", "comment"),
    "category_code": ("categoryCode", "catCode", "category.code"),
    "category_name": ("categoryName", "category.name", "category", "lotCategory", "lotCategoryName"),
    "region": ("subjectRFName", "subjectName", "subjectRF", "subject.label", "regionName", "rfSubject", "locationRegion", "lotAddress.subjectName"),
    "address": ("address", "location", "locationAddress", "objectAddress", "estateAddress", "fiasAddress", "lotAddress", "addr"),
    "cadastral": ("cadastralNumbers", "cadastralNumber", "cadNumber", "cadNumbers"),
    "status": ("lotStatus", "status", "statusCode", "lotStatusName", "statusName", "state"),
    "published": ("firstVersionPublicationDate", "publishDate", "publicationDate", "publishedAt"),
    "closes": ("biddEndTime", "biddEndDate", "applicationEndDate", "applicationsEndDate"),
    "auction": ("auctionStartDate", "biddingDate", "tradeDate"),
    "url": ("lotUrl", "url", "href", "link"),
}
START_PRICE_KEYS = ("priceMin", "initialPrice", "startPrice", "price", "lotPrice")
CURRENT_PRICE_KEYS = ("currentPrice", "priceFin", "finalPrice", "actualPrice")
AREA_KEYS = ("area", "square", "totalArea", "landArea", "objectArea")
AMOUNT_KEYS = ("amount", "value", "price", "sum", "rub", "number")
CATEGORY_OF_CODE = {
    "903": "commercial_building_with_land", "22": "transport", "7": "real_estate", "8": "real_estate", "9": "real_estate", "10": "real_estate", "11": "real_estate",
    "12": "real_estate", "2": "land", "5": "other", "6": "other", "23": "other", "17": "other", "900": "other", "13": "other",
}
# Keys of an official register's messages.
MESSAGE_KEYS = {
    "id": ("guid", "id", "messageGuid", "tradeMessageGuid"), "title": ("title", "messageType", "typeName"), "description": ("description", "content", "text"),
    "price": ("currentPrice", "startPrice", "price"), "region": ("regionName", "region"), "address": ("address", "location"), "cadastral": ("cadastralNumber",), "vin": ("vin",),
    "number": ("number", "messageNumber"), "debtor": ("debtorName", "bankruptName"), "organizer": ("tradeOrganizerName", "organizerName"),
    "manager": ("arbitrManagerName", "arbitrationManagerName"), "case": ("caseNumber",), "platform": ("tradePlaceName",),
}
REGION_IN_TEXT = r"([А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁа-яё-]+){0,2}\s+(?:область|край|республика|округ))"
TITLE_LENGTH, DESCRIPTION_LENGTH = 500, 5000
#: What a listing's dates are called.
DATE_TITLES = {"published": "Дата публикации", "closes": "Окончание подачи заявок", "auction": "Дата проведения торгов"}


def as_record(df: DataFrame, **fields: Column) -> DataFrame:
    """df as RECORD: the given fields, cast to their types; land_risk_flag is false unless given, the others null."""
    given = {"land_risk_flag": F.lit(False)} | fields
    schema = T.StructType.fromDDL(RECORD)
    if unknown := set(given) - set(schema.names):
        raise ValueError(f"no fields of a record: {', '.join(sorted(unknown))}")
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _scalars(value: Any) -> list[Any]:
    """The numbers and texts of a value that may hold an amount: an object's by AMOUNT_KEYS, a list's in order."""
    if isinstance(value, dict):
        return [x for k in AMOUNT_KEYS for x in _scalars(value.get(k))]
    if isinstance(value, list):
        return [x for v in value for x in _scalars(v)]
    return [] if value in (None, "") else [value]


def _told(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


_PICKED = T.StructType([T.StructField("text", T.MapType(T.StringType(), T.StringType())), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("start", "current", "areas")]])


@F.pandas_udf(_PICKED)
def _picked(payloads: pd.Series) -> pd.DataFrame:
    """What LISTING_KEYS find, with a digest of the whole; amounts and areas as JSON scalars, all that were found."""
    rows = []
    for raw in payloads:
        payload = jsonwalk._parse(raw)
        values = jsonwalk.first_values(payload)
        found = {name: jsonwalk.pick(payload, *keys, values=values) for name, keys in LISTING_KEYS.items()}
        found["digest"] = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:20]
        amounts = [[_told(x) for k in keys for x in _scalars(jsonwalk.deep_find(payload, k, values))] for keys in (START_PRICE_KEYS, CURRENT_PRICE_KEYS)]
        areas = [jsonwalk.deep_find(payload, k, values) for k in AREA_KEYS]
        rows.append((found, *amounts, [_told(x if isinstance(x, (int, float, str)) else _told(x)) for x in areas if x not in (None, "")]))
    return pd.DataFrame(rows, columns=["text", "start", "current", "areas"])


def _first_of(scalars: Column, read) -> Column:
    """The first JSON scalar that is a number, or a text that read finds one in."""
    one = lambda x: F.coalesce(x.try_cast("double"), read(F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")))
    return F.get(F.filter(F.transform(scalars, one), lambda v: v.isNotNull()), F.lit(0))


def _area_in(c: Column) -> Column:
    return F.nullif(extract.area(c)["value"], F.lit(0.0))


def absolute(url: Column, base: str) -> Column:
    """An address of a page below base in full; one with a scheme stays."""
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit(base.split(":")[0] + ":"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(base + "/"), url))


def region_in(c: Column | str) -> Column:
    """The first name of a region that a text holds, or null."""
    return F.nullif(F.regexp_extract(text.col(c), REGION_IN_TEXT, 1), F.lit(""))


def of_listings(rows: DataFrame, payload: str, source: str, system: str, base: str) -> DataFrame:
    """Answers of a listing source (a JSON object a row) as records.

    The id is the source's own, else its notice and lot numbers, else a hash of the whole; a title that lacks is made from
    the description or the id, a description from the title. What is no JSON object gives a record without facts.
    raw_data holds the answer (raw) and, read from it, status, numbers, the end of applications and the auction's start.
    """
    p = rows.select(F.col(payload).alias("_raw"), _picked(F.coalesce(F.col(payload), F.lit("null"))).alias("_p"))
    t = lambda name: F.nullif(text.clean(F.try_element_at(F.col("_p.text"), F.lit(name))), F.lit(""))
    base_id = F.coalesce(t("id"), text.join_ids(t("notice"), t("lot")), t("digest"))
    title = F.coalesce(t("title"), F.left(t("description"), F.lit(200)), F.concat(F.lit(f"Лот {system} "), base_id))
    p = p.select("*", base_id.alias("_id"), title.alias("_title"), F.coalesce(t("description"), title).alias("_description"))
    p = p.withColumn("_region", F.coalesce(t("region"), region_in("_description"))).withColumn("_address", F.coalesce(t("address"), extract.address("_description")))
    p = p.withColumn("_said", F.concat_ws(" ", "_title", "_description", "_address", "_region"))
    p = p.withColumn("_numbers", extract.cadastral_numbers(F.concat_ws(" ", t("cadastral"), "_said")))
    start = _first_of(F.col("_p.start"), money.parse_money)
    own = F.concat(F.lit(f"{base}/new/public/lots/lot/"), F.col("_id"), F.lit("/(lotInfo:info)?fromRec=false"))
    url = F.coalesce(absolute(t("url"), base), own)
    kept = {"source": F.lit(source), "status": t("status"), "notice_number": t("notice"), "lot_number": t("lot"), "category_code": t("category_code"), "bidd_end_time": t("closes"), "auction_start_date": t("auction")}
    titled = F.array(*[F.struct(F.lit(title).alias("title"), F.coalesce(t(name), F.lit("")).alias("text")) for name, title in DATE_TITLES.items()])
    return as_record(
        p,
        external_id=F.concat(F.lit(source + ":"), "_id"),
        source=F.lit(source),
        source_system=F.lit(system),
        title=F.left("_title", F.lit(TITLE_LENGTH)),
        description=F.left("_description", F.lit(DESCRIPTION_LENGTH)),
        category=classify.category_of_source(t("category_code"), CATEGORY_OF_CODE, t("category_name"), F.col("_title"), F.col("_description")),
        region_slug=text.slug("_region"),
        region_name=F.col("_region"),
        address=F.col("_address"),
        cadastral_number=F.try_element_at("_numbers", F.lit(1)),
        area=F.coalesce(_first_of(F.col("_p.areas"), _area_in), _area_in(F.col("_said")), extract.land_area("_said")),
        start_price=start,
        current_price=F.coalesce(F.nullif(_first_of(F.col("_p.current"), money.parse_money), F.lit(0.0)), start),
        auction_status=classify.catalogue_status(t("status")),
        lot_url=url,
        source_url=url,
        detail_level=F.lit("search"),
        raw_data=F.to_json(F.struct(*[F.coalesce(v, F.lit("")).alias(n) for n, v in kept.items()], F.col("_numbers").alias("cadastral_numbers"), titled.alias("dates"), F.col("_raw").alias("raw"))),
        published_at=dates.parse(t("published"), keep_zone=False),
        application_deadline=dates.parse(t("closes"), keep_zone=False),
        auction_at=dates.parse(t("auction"), keep_zone=False),
        notice_number=t("notice"),
        land_area=extract.land_area("_said"),
        total_area_gba=F.coalesce(extract.building_area("_said"), extract.room_area("_said")),
    )


def _entry(entries: str, key: str) -> Column:
    """The first value under a key, whatever its case, that is not null or empty."""
    return F.get(F.filter(entries, lambda e: (F.lower(e["key"]) == key) & ~e["value"].isin("", "[]", "{}")), F.lit(0))["value"]


def of_messages(rows: DataFrame, payload: str, source: str, system: str, card: str, api: str) -> DataFrame:
    """Messages of an official register (a JSON object a row) as records; keys in any case, at the top only.

    card and api are addresses that the id is put behind. A message without an id goes, for nothing names it.
    """
    m = rows.select(F.col(payload).alias("_raw"), F.map_entries(F.from_json(payload, "map<string,string>")).alias("_m"))

    def t(name: str) -> Column:
        return F.coalesce(*[_entry("_m", key.lower()) for key in MESSAGE_KEYS[name]])

    title, description, price = F.coalesce(t("title"), F.concat(F.lit(f"Сообщение {system} "), t("id"))), F.coalesce(t("description"), F.lit("")), t("price").try_cast("double")
    return as_record(
        m.where(t("id").isNotNull()),
        external_id=t("id"),
        source=F.lit(source),
        source_system=F.lit(system),
        title=F.left(title, F.lit(TITLE_LENGTH)),
        description=F.left(description, F.lit(DESCRIPTION_LENGTH)),
        category=classify.category(title, description),
        region_name=t("region"),
        address=t("address"),
        cadastral_number=t("cadastral"),
        vin=t("vin"),
        start_price=price,
        current_price=price,
        auction_status=F.lit("unknown"),
        lot_url=F.concat(F.lit(card), t("id")),
        source_url=F.concat(F.lit(api), t("id")),
        detail_level=F.lit("official_api"),
        raw_data=F.col("_raw"),
        efresb_message_number=F.coalesce(t("number"), t("id")),
        debtor_name=t("debtor"),
        organizer_name=t("organizer"),
        auction_manager_name=t("manager"),
        bankruptcy_case_number=t("case"),
        platform_name=t("platform"),
    )


def of_products(pages: DataFrame, html: str, source: str, system: str, base: str, status: str = "unknown", platform: str | None = None) -> DataFrame:
    """Catalogue pages (HTML a row) as records, each product once over all pages; facts are read from its title."""
    from . import cards

    c = pages.select(F.explode(cards.product_cards_of(html)).alias("c")).select("c.*").dropDuplicates(["ident"])
    price, url = money.parse_money("price_text"), absolute(F.col("url"), base)
    raw = F.to_json(F.struct(F.col("ident").alias("product_id"), "price_text", F.col("code").alias("procedure_number"), F.transform("images", lambda i: absolute(i, base)).alias("image_urls")))
    return as_record(
        c,
        external_id=F.concat(F.lit(source + ":"), "ident"),
        source=F.lit(source),
        source_system=F.lit(system),
        title=F.left("title", F.lit(TITLE_LENGTH)),
        description=F.left("title", F.lit(DESCRIPTION_LENGTH)),
        category=classify.category("title", "title"),
        address=extract.address("title"),
        cadastral_number=F.try_element_at(extract.cadastral_numbers("title"), F.lit(1)),
        area=_area_in(F.col("title")),
        start_price=price,
        current_price=price,
        auction_status=F.lit(status),
        lot_url=url,
        source_url=url,
        detail_level=F.lit("search"),
        raw_data=raw,
        platform_name=F.lit(platform),
        procedure_number=F.col("code"),
    )


def of_links(pages: DataFrame, html: str, source: str, system: str, base: str) -> DataFrame:
    """Pages without known cards as records: what links to a lot, each lot once over all pages; facts are read from the text around it."""
    from . import cards

    c = pages.select(F.explode(cards.lot_links_of(html)).alias("c")).select("c.*").dropDuplicates(["ident"]).withColumn("region", region_in("text"))
    price, url = F.nullif(extract.price("text")["value"], F.lit(0.0)), absolute(F.col("url"), base)
    return as_record(
        c,
        external_id=F.concat(F.lit(source + ":"), "ident"),
        source=F.lit(source),
        source_system=F.lit(system),
        title=F.left("title", F.lit(TITLE_LENGTH)),
        description=F.left("text", F.lit(DESCRIPTION_LENGTH)),
        category=classify.category("title", "text"),
        region_slug=text.slug("region"),
        region_name=F.col("region"),
        address=extract.address("text"),
        cadastral_number=F.try_element_at(extract.cadastral_numbers("text"), F.lit(1)),
        area=F.coalesce(_area_in(F.col("text")), extract.land_area("text")),
        start_price=price,
        current_price=price,
        auction_status=classify.catalogue_status("text"),
        lot_url=url,
        source_url=url,
        detail_level=F.lit("search"),
        raw_data=F.to_json(F.struct(F.lit("html_fallback").alias("source"), "title", url.alias("url"), F.left("text", F.lit(DESCRIPTION_LENGTH)).alias("text"))),
    )


# A filter's name and the parameter of the listing source.
LISTING_PARAMETERS = {
    "search_text": "text", "type_transaction": "typeTransaction", "subject_rf": "dynSubjRF", "fias": "fias", "ownership_form": "ownershipForm", "category_code": "catCode",
    "lot_status": "lotStatus", "currency_code": "currCode", "publish_date_from": "pubFrom", "publish_date_to": "pubTo", "bidd_end_time_from": "biddEndFrom",
    "bidd_end_time_to": "biddEndTo", "auction_start_date_from": "aucStartFrom", "auction_start_date_to": "aucStartTo", "notice_number": "noticeNumber", "etp_code": "etpCode",
    "bidd_type": "biddType", "bidd_form": "biddForm", "notice_status": "noticeStatus", "organizer_name": "organizerName", "organizer_inn": "organizerInn",
    "right_holder_name": "rightHolderName", "right_holder_inn": "rightHolderInn", "attachment_text": "attachmentText",
}
# What every request says unless a filter says otherwise, and a parent category's own categories.
LISTING_DEFAULTS = {"byFirstVersion": "true", "withFacets": "false", "sort": "firstVersionPublicationDate,desc", "lotStatus": "PUBLISHED,APPLICATIONS_SUBMISSION", "catCode": "2,8,9,10,11,12,903", "typeTransaction": "sale"}
CATEGORY_GROUPS = {"7": "8,9,10,11,12"}
LARGEST_PAGE = 100


def listing_parameters(filters: dict[str, Any], codes: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, Any], list[str]]:
    """Parameters of a request, the filters that are left to Spark, and warnings.

    codes are regions' codes by name. Pages count from 1 here and from 0 there; a location that is no identifier of the
    address register, and every filter that the source does not know, are left to Spark.
    """
    size = min(max(int(filters.get("page_size") or LARGEST_PAGE), 1), LARGEST_PAGE)
    warnings = ["page size is held between 1 and 100"] if filters.get("page_size") not in (None, 0, size) else []
    out = LISTING_DEFAULTS | {"page": str(max(int(filters.get("page") or 1), 1) - 1), "size": str(size), "matchPhrase": "true" if filters.get("match_phrase") else "false"}
    left: dict[str, Any] = {}
    for name, value in filters.items():
        if value in (None, "", []) or name in ("page", "page_size", "match_phrase"):
            continue
        said = ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value).strip()
        if name in ("price_min", "price_max"):
            out["priceMin" if name == "price_min" else "priceMax"] = f"{float(value):f}".rstrip("0").rstrip(".")
        elif name == "is_msp":
            out |= {"isMsp": "true"} if value else {}
        elif name not in LISTING_PARAMETERS or (name == "fias" and not re.fullmatch(text.GUID, said)):
            left[name] = value
            warnings.append(f"{name} is applied after loading")
        else:
            changed = {"subject_rf": (codes or {}).get(said, said), "category_code": CATEGORY_GROUPS.get(said, said), "type_transaction": said.lower()}
            out[LISTING_PARAMETERS[name]] = changed.get(name, said)
    return out, left, warnings


# Places that a source's text search does not find, so that their names are looked for in what it gave.
LOCAL_PLACES = (
    "москва", "санкт петербург", "санкт-петербург", "севастополь", "ярославль", "липецк", "омск", "тула", "краснодар", "ростов", "самара", "пермь", "киров", "псков", "екатеринбург",
    "челябинск", "тюмень", "воронеж", "калуга", "владимир", "иваново", "кострома", "рязань", "тверь", "смоленск",
)


def filters_locally(term: str | None, parameters: dict[str, str]) -> bool:
    """Whether a search text is to be applied to what was loaded: it was not sent, or names no more than a place."""
    low = " ".join((term or "").lower().replace("ё", "е").split())
    return bool(low) and (not parameters.get("text") or " ".join(re.findall("[0-9a-zа-я]+", low)) in LOCAL_PLACES)


def run_specs(region_code: str | None = None, region_name: str | None = None) -> list[tuple[str, dict[str, Any], str | None]]:
    """What a run asks of each source: (source, filters, the region that absences are counted in, or none).

    Without a region it is a run over the whole country, which may archive anywhere; with one, over that region alone.
    """
    # The sources, their real estate and their pages.
    specs = {
        "listing": {"type_transaction": "SALE", "category_code": LISTING_DEFAULTS["catCode"], "lot_status": LISTING_DEFAULTS["lotStatus"], "page": 1, "page_size": 100},
        "search": {"page": 1, "page_size": 100},
        "catalogue": {"archive_mode": "false", "page": 1, "page_size": 96},
    }
    if region_code:
        specs["listing"]["subject_rf"] = specs["search"]["region"] = region_code
        specs["catalogue"]["region_feature"] = region_name
    return [(source, filters, region_code) for source, filters in specs.items()]
