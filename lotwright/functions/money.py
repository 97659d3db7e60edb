"""Amounts: parsing, discount, rating, tolerance, bid ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

# Fixed values of the rating.
LIQUIDITY = {"apartment": 20, "house": 14, "commercial_room": 10, "commercial_building": 8, "commercial_building_with_land": 8, "land": 7, "parking": 9, "unfinished": 3, "receivable": 2, "other": 3}
LIQUIDITY_ELSE = 4
VILLAGE_TERMS = (" д ", " дерев", " с ", " село", "посел", "р-н", "район")
# Fixed values of the bid scenarios: factors of the sale price, the costs and the months.
SCENARIOS = {"pessimistic": (0.90, 1.15, 1.25), "base": (1.00, 1.00, 1.00), "optimistic": (1.05, 0.95, 0.80)}
PRICE_TOLERANCE, PRICE_VETO = 0.001, 0.05


def number(c: Column | str) -> Column:
    """A number with blanks between thousands and a comma or point, or null."""
    return F.regexp_replace(F.translate(col(c), "    \t\n", ""), ",", ".").try_cast("double")


def parse_money(c: Column | str) -> Column:
    """The first amount in a text; currency marks and blanks are passed over."""
    bare = F.regexp_replace(F.translate(col(c), "  ₽", "  "), r"руб\.?", "")
    return number(F.nullif(F.regexp_extract(bare, r"\d[\d\s]*(?:[,.]\d+)?", 0), F.lit("")))


def discount_percent(market: Column | str, price: Column | str) -> Column:
    m, p = col(market), col(price)
    return F.when((m > 0) & (p != 0), F.round((m - p) / m * 100, 2))


def profit(market: Column | str, price: Column | str) -> Column:
    return (col(market) - col(price)).cast("double")


def rating(discount: Column, risk: Column, status: Column, confidence: Column, category: Column, legal: Column, address: Column, area: Column) -> Column:
    """0 to 100; null without discount or risk, 0 for what is not active or scheduled."""
    table = F.create_map(*[F.lit(x) for kv in LIQUIDITY.items() for x in kv])
    law, where = F.lower(F.coalesce(legal, F.lit(""))), F.lower(F.coalesce(address, F.lit("")))
    village = F.lit(False)
    for term in VILLAGE_TERMS:
        village = village | where.contains(term)
    score = F.greatest(F.lit(-50.0), F.least(discount.cast("double"), F.lit(95.0))) * 0.35 + (10 - risk) * 3.0 + F.coalesce(F.try_element_at(table, category), F.lit(LIQUIDITY_ELSE))
    for test, points in (
        (confidence == "low", 10),
        (confidence == "medium", 4),
        (law.contains("культурн") | law.contains("наслед"), 20),
        (F.length(where) < 15, 8),
        (F.coalesce(area, F.lit(0.0)) == 0, 8),
        (category.startswith("commercial_") & village, 8),
    ):
        score = score - F.when(test, points).otherwise(0)
    return F.when(discount.isNull() | risk.isNull(), None).when(~F.coalesce(status.isin("active", "scheduled"), F.lit(False)), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 2))


def needs_review(confidence: Column | str) -> Column:
    return F.lower(col(confidence)).isin("низкая", "low")


def prices_match(a: Column | str, b: Column | str) -> Column:
    """Within a tenth of a percent of the smaller, or one unit."""
    x, y = col(a), col(b)
    return F.coalesce(F.abs(x - y) <= F.greatest(F.lit(1.0), F.least(F.abs(x), F.abs(y)) * PRICE_TOLERANCE), F.lit(False))


def prices_diverge(a: Column | str, b: Column | str) -> Column:
    x, y = col(a), col(b)
    return F.coalesce(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) > PRICE_VETO, F.lit(False))


def backoff_seconds(attempt: Column | str, base: float, cap: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), col(attempt) - 1), F.lit(float(cap)))


def weaker_confidence(confidence: Column, evidence: Column, needed: int) -> Column:
    """A step down where there is less evidence than needed."""
    return F.when(evidence >= needed, confidence).when(confidence == "high", "medium").otherwise("low")


def bid_scenarios(
    df: DataFrame, sale: Column, repair: Column, legal: Column, holding: Column, months: Column, taxes: Column, commission: Column, target: Column, reserve: Column, capital: Column, bid: Column
) -> DataFrame:
    """Three rows for each row of df: scenario, sale_price, maximum_bid, and for a given bid profit, returns and breakeven.

    commission and capital are percents. Rows that are out of range (negative values, no sale price or months, percents
    over 100) give none.
    """
    given = {"sale": sale, "repair": repair, "legal": legal, "holding": holding, "months": months, "taxes": taxes, "commission": commission, "target": target, "reserve": reserve, "capital": capital, "bid": bid}
    named = df.select("*", F.struct(*[v.cast("double").alias(k) for k, v in given.items()]).alias("_in"))
    x = {k: F.col(f"_in.{k}") for k in given}
    valid = (x["sale"] > 0) & (x["months"] > 0) & (x["commission"] <= 100) & (x["capital"] <= 100)
    for k in given:
        valid = valid & (x[k].isNull() | (x[k] >= 0))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(v).alias(c) for v, c in zip(f, ("fs", "fc", "fm"), strict=True)]) for n, f in SCENARIOS.items()]))
    s = named.where(valid).withColumn("_s", rows).withColumn("scenario", F.col("_s.scenario"))
    s = s.withColumn("_price", x["sale"] * F.col("_s.fs")).withColumn("_months", F.greatest(x["months"] * F.col("_s.fm"), F.lit(0.1)))
    s = s.withColumn("_costs", (x["repair"] + x["legal"] + x["taxes"] + x["reserve"]) * F.col("_s.fc") + F.when(x["months"] * F.col("_s.fm") >= 0.1, x["holding"] * x["months"] * F.col("_s.fm")).otherwise(x["holding"] * 0.1) + F.col("_price") * x["commission"] / 100)
    s = s.withColumn("_factor", 1 + x["capital"] / 100 * F.col("_months") / 12)
    s = s.withColumn("_spent", x["bid"] * F.col("_factor") + F.col("_costs")).withColumn("_roi", F.when(F.col("_spent") > 0, (F.col("_price") - F.col("_spent")) / F.col("_spent") * 100))
    # To the cent by the binary value, halves away from zero: round() would first write the double in decimal.
    r2 = lambda c: F.signum(c) * F.floor(F.abs(c) * 100 + 0.5) / 100
    return s.select(
        *df.columns,
        "scenario",
        r2(F.col("_price")).alias("sale_price"),
        r2(F.greatest(F.lit(0.0), (F.col("_price") - F.col("_costs") - x["target"]) / F.col("_factor"))).alias("maximum_bid"),
        r2(F.col("_price") - F.col("_spent")).alias("expected_profit"),
        r2(F.col("_roi")).alias("roi_percent"),
        r2(F.when(F.col("_roi") > -100, (F.pow(1 + F.col("_roi") / 100, 12 / F.col("_months")) - 1) * 100)).alias("annualized_return_percent"),
        r2(F.col("_spent")).alias("breakeven_sale_price"),
        r2(F.col("_months")).alias("holding_months"),
    )


def cents(c: Column | str) -> Column:
    """Two digits after the point by the binary value, as a decimal."""
    x = col(c).cast("double")
    return (F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100).cast("decimal(15,2)")


def query_number(c: Column | str, comma: bool = False) -> Column:
    """A number as a query has it: whole ones without a point, others with a point or a comma."""
    x = col(c).cast("double")
    text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


# Bounds of an evaluation.
LONGEST_EXPLANATION, LONGEST_TIME, MOST_LINKS = 10_000, 500, 50
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]")
DISCLAIMER = "Предварительная машинная гипотеза; не является независимой оценкой имущества."


def evaluation_problems(price: Column, low: Column, high: Column, confidence: Column, explanation: Column, links: Column, risk: Column, advice: Column, time_to_sell: Column) -> Column:
    """What is wrong with an evaluation, as an array of names; empty if it is valid."""
    ok = lambda test: F.coalesce(test, F.lit(False))
    sized = lambda c, most: ok(F.length(c).between(1, most))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https://([^/:?#]+|\[[^\]]*\])", 1))
    public = F.coalesce(F.forall(links, lambda u: u.startswith("https://") & (host(u) != "") & ~host(u).isin(*LOCAL_HOSTS)) & (F.size(links) <= MOST_LINKS), F.lit(True))
    tests = {
        "price": ok(price > 0) & ok(low > 0) & ok(high > 0),
        "range": ok((low <= price) & (price <= high)),
        "confidence": ok(confidence.isin("low", "medium", "high")),
        "explanation": sized(explanation, LONGEST_EXPLANATION),
        "links": public,
        "risk": ok(risk.between(1, 10)),
        "recommendation": sized(advice, LONGEST_EXPLANATION),
        "time_to_sell": sized(time_to_sell, LONGEST_TIME),
    }
    return F.filter(F.array(*[F.when(~test, name) for name, test in tests.items()]), lambda x: x.isNotNull())


def advice_text(advice: Column, time_to_sell: Column) -> Column:
    return F.concat(F.lit(DISCLAIMER + "\n\n"), advice, F.lit("\n\nОжидаемый срок продажи: "), time_to_sell)


def within(price: Column, low: float = 0, high: float = 0) -> Column:
    """Within bounds of which 0 is none; with a bound, a row without a price is out."""
    given = F.coalesce(price, F.lit(0))
    return (F.lit(not low) | (given != 0) & (given >= low)) & (F.lit(not high) | (given != 0) & (given <= high))


ASSESSMENT = "market_price double, min_price double, max_price double, confidence string, explanation string, links array<string>, risk_score int, recommendation string, time_to_sell string"
REVIEW_NOTE = "Обязательна независимая проверка оценщиком, юристом и техническим специалистом."
SPARSE_NOTE = "Confidence reduced because verifiable comparables or key property facts are missing."


def assessment(market: Column, risk: Column, sparse: Column) -> Column:
    """A struct of an evaluation's columns from two answers (JSON objects that are repaired already), with its problems.

    With sparse evidence, or without links, the confidence is low and the explanation says so. Prices are decimals of two
    digits. Columns are as answered if there are problems, so that they can be shown; they are to be written without any.
    """
    m, r = F.from_json(market, ASSESSMENT), F.from_json(risk, ASSESSMENT)
    links = F.coalesce(m["links"], F.array().cast("array<string>"))
    weak = F.coalesce(sparse, F.lit(True)) | (F.size(links) == 0)
    problems = evaluation_problems(m["market_price"], m["min_price"], m["max_price"], m["confidence"], m["explanation"], links, r["risk_score"], r["recommendation"], r["time_to_sell"])
    prices = [cents(m[c]).alias(c) for c in ("market_price", "min_price", "max_price")]
    return F.struct(
        *prices,
        F.when(weak, "low").otherwise(m["confidence"]).alias("confidence"),
        F.when(weak, F.concat(F.lit(SPARSE_NOTE + " "), m["explanation"])).otherwise(m["explanation"]).alias("explanation"),
        links.alias("links"),
        r["risk_score"].alias("risk_score"),
        advice_text(F.concat(r["recommendation"], F.lit("\n\n" + REVIEW_NOTE)), r["time_to_sell"]).alias("advice"),
        F.lit(True).alias("needs_human_review"),
        problems.alias("problems"),
    )
