"""Source cards, canonical assets, places and valuations of lots as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from . import resolve


def card_columns(raw: str, typed: dict[str, tuple[str, ...]], status: str) -> list[Column]:
    """Columns of a source card: the explicit column if it is not empty, else the first such key of the raw JSON; archived by status."""
    out = []
    for name, keys in typed.items():
        own = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        out.append(F.coalesce(own, *[F.nullif(F.get_json_object(F.col(raw), f"$.{k}"), F.lit("")) for k in keys]).alias(name))
    return [*out, F.coalesce(F.col(status).isin("closed", "archived"), F.lit(False)).alias("archived")]


def canonical_ids(cards: DataFrame, key: str, ident: str) -> DataFrame:
    """cards with canonical_id: the least id of all cards of the same canonical key; a card without key is its own."""
    least = cards.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("_least"))
    return cards.join(least, key, "left").withColumn("canonical_id", F.coalesce("_least", ident)).drop("_least")


def missing_links(rows: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """The links that rows need and links lack, each once."""
    return rows.select(*on).distinct().join(links.select(*on), on, "left_anti")


def first_match(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, match) for each fresh row: the known row of another source that shares its identifier, else one whose price
    matches; the least id of these. Both have id, source, identifier, price. Prices far apart veto an identifier.

    Fresh rows that ask for the same are looked up once. Of known rows of one price (and identifier) two can be an answer
    alone: the least id, and the least of another source than that one's.
    """
    known = known.where(F.col("id").isNotNull() & F.col("source").isNotNull())

    def met(keys: list[str], join) -> DataFrame:
        least = newest(known.dropna(subset=keys[:1]).groupBy(*keys, "source").agg(F.min("id").alias("id")), keys, [F.col("id")], 2)
        k = least.select(*[F.col(c).alias(f"k_{c}") for c in least.columns])
        f = fresh.dropna(subset=[keys[0], "source"]).select(*[F.col(c).alias(f"f_{c}") for c in (*keys, "source")]).distinct()
        same = F.struct(*[F.col(f"f_{c}").alias(c) for c in (*keys, "source")])  # in a struct nulls are equal
        return join(f, k).where(F.col("f_source") != F.col("k_source")).groupBy(same.alias("_asked")).agg(F.min("k_id").alias("match"))

    by_id = met(["identifier", "price"], lambda f, k: f.join(k, F.col("f_identifier") == F.col("k_identifier")).where(~money.prices_diverge("f_price", "k_price")))
    by_price = met(["price"], lambda f, k: resolve.band_join(f, k, "f_price", "k_price"))
    out = fresh.withColumn("_asked", F.struct("identifier", "price", "source")).join(by_id.withColumnRenamed("match", "_by_id"), "_asked", "left")
    out = out.withColumn("_asked", F.struct("price", "source")).join(by_price.withColumnRenamed("match", "_by_price"), "_asked", "left")
    return out.select("id", F.coalesce("_by_id", "_by_price").alias("match"))


def places(lots: DataFrame, by_number: DataFrame, by_address: DataFrame) -> DataFrame:
    """lots (id, number, address) with lat, lon, geo_method: by number first, else by address, else null and unresolved."""
    n = by_number.select(F.col("number"), F.struct("lat", "lon").alias("_n"))
    a = by_address.select(F.col("address"), F.struct("lat", "lon").alias("_a"))
    both = lots.join(n, "number", "left").join(a, "address", "left")
    place = F.coalesce("_n", "_a")
    method = F.when(F.col("_n").isNotNull(), "cadastral").when(F.col("_a").isNotNull(), "address").otherwise("unresolved")
    return both.select(*lots.columns, place["lat"].alias("lat"), place["lon"].alias("lon"), method.alias("geo_method"))


def filled_address(own: Column, found: Column, least: int = 15) -> Column:
    """A lot's address, or the found one where it has none or a shorter one than least."""
    return F.when(F.coalesce(F.length(own), F.lit(0)) < least, F.coalesce(F.nullif(found, F.lit("")), own)).otherwise(own)


def cached_valuation(asked: DataFrame, runs: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """asked with value of the latest run of the same key, null where none was made."""
    return asked.join(runs.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value)), key, "left")


def primaries(rows: DataFrame, ident: str, primary: str) -> DataFrame:
    """Each row's primary, or itself where it has none, once."""
    return rows.select(F.coalesce(primary, ident).alias(ident)).distinct()


def newest(rows: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first keep rows of each key by order; Spark drops later ones before the shuffle already."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_nth") <= keep).drop("_nth")


def open_circuits(failures: DataFrame, service: str, at: str, as_of: Column, seconds: int = 300) -> DataFrame:
    """Services whose last failure is less than so many seconds ago: they are not to be asked."""
    last = failures.groupBy(service).agg(F.max(at).alias("last"))
    return last.withColumn("available", F.coalesce(as_of.cast("timestamp").cast("long") - F.col("last").cast("timestamp").cast("long") >= seconds, F.lit(True)))


def lease_holder(runs: DataFrame, started: str, beat: str, as_of: Column, minutes: int = 10) -> DataFrame:
    """The one run that holds the lease: the earliest started of those whose heartbeat is younger than so many minutes."""
    alive = runs.where(as_of.cast("timestamp").cast("long") - F.col(beat).cast("timestamp").cast("long") < 60 * minutes)
    return alive.orderBy(started, "id").limit(1)


def scheduled(requests: DataFrame, states: DataFrame, key: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """requests (key, force) with action: queued, or skipped-already-running while a run is waiting or at work.

    states (key, status, started, requested), a row for each key. A run that has been at it for longer than minutes is
    stuck and is started anew, as is one that is forced.
    """
    busy = F.coalesce(F.col("status").isin("queued", "running"), F.lit(False)) & ~dates.stuck(F.col("started"), F.col("requested"), as_of, minutes)
    action = F.when(busy & ~F.coalesce("force", F.lit(False)), "skipped-already-running").otherwise("queued")
    return requests.join(states, key, "left").select(*requests.columns, action.alias("action"))


def looked_up_once(rows: DataFrame, key: Column, lookup) -> DataFrame:
    """rows with what lookup finds for their key: each different key is looked up once, however many rows ask for it.

    lookup takes a DataFrame (key) and gives it back with its findings. Rows whose key is null are not looked up.
    """
    keyed = rows.withColumn("_key", key)
    found = lookup(keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key")).distinct())
    return keyed.join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def source_parts(source: Column | str, prefix: str, system: str) -> Column:
    """A struct (system, region) of a stored source that may hold its region behind prefix; others stand for themselves."""
    s = F.col(source) if isinstance(source, str) else source
    held = s.startswith(prefix)
    return F.struct(F.when(held, system).otherwise(s).alias("system"), F.when(held, F.nullif(s.substr(F.lit(len(prefix) + 1), F.length(s)), F.lit(""))).alias("region"))


def etag(response: DataFrame, *without: str) -> Column:
    """A hash of each row as JSON with its columns by name, but for those of timings."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(response.columns) if c not in without]), {"ignoreNullFields": "false"}), 256)
