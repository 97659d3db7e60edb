"""Assets across sources: duplicates, bands, survivors, joins of publications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import classes, resolve
from .catalogue import query
from .registry import table


@query("publications_per_asset", """
SELECT l_orderkey, count(*) AS publications, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS first_supplier, max(l_shipdate) AS last_date, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS sources
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def publications_per_asset(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("publications"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("first_supplier"), F.max("l_shipdate").alias("last_date"), F.array_join(F.array_sort(F.collect_set("s_name")), "; ").alias("sources")
    )


KEYS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"))


@query("orphan_check", " UNION ALL ".join(f"SELECT '{a}.{b}' AS reference, count(*) AS orphans FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {c} WHERE {e} = {b})" for a, b, c, e in KEYS))
def orphan_check(spark, d):
    out = None
    for a, b, c, e in KEYS:
        one = table(spark, d, a).select(b).join(table(spark, d, c).select(F.col(e).alias(b)), b, "left_anti").agg(F.lit(f"{a}.{b}").alias("reference"), F.count(F.lit(1)).alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("survivor_star_merge", """
WITH k AS (SELECT *, lower(trim(text)) AS body FROM documents)
SELECT min(doc_id) AS doc_id, count(*) AS publications, count(DISTINCT source) AS sources FROM k GROUP BY body HAVING count(*) > 1""")
def survivor_star_merge(spark, d):
    docs = table(spark, d, "documents").withColumn("body", F.sha2(F.lower(F.trim("text")), 256))
    return docs.groupBy("body").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("publications"), F.count_distinct("source").alias("sources")).where("publications > 1").drop("body")


@query("price_band_join", """
SELECT a.p_partkey AS left_part, b.p_partkey AS right_part FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand
AND a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= greatest(1.0, least(abs(a.p_retailprice), abs(b.p_retailprice)) * 0.001)""")
def price_band_join(spark, d):
    p = table(spark, d, "part")
    cols = ("p_partkey", "p_brand", "p_size", "p_retailprice")
    found = resolve.band_join(p.select(*[F.col(c).alias("l_" + c) for c in cols]), p.select(*[F.col(c).alias("r_" + c) for c in cols]), "l_p_retailprice", "r_p_retailprice")
    same = (F.col("l_p_partkey") < F.col("r_p_partkey")) & (F.col("l_p_brand") != F.col("r_p_brand")) & (F.col("l_p_size") == F.col("r_p_size"))
    return found.where(same).select(F.col("l_p_partkey").alias("left_part"), F.col("r_p_partkey").alias("right_part"))


def asset_rows(spark, d):
    """Parts as publications of four sources, every fifth of which has an identifier."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"), F.when(k % 5 == 0, F.array((k % 50).cast("string"))).otherwise(F.array().cast("array<string>")).alias("identifiers"),
        F.col("p_retailprice").alias("price"), F.concat_ws(" ", "p_name", "p_type").alias("address"), F.col("p_name").alias("title"), F.col("p_brand").alias("region"),
    )


# The parts' names have two words, so titles, which need three, decide nothing here; alike_titles is about these.
_APART = "abs(a.price - b.price) / greatest(abs(a.price), abs(b.price), 1) > 0.05"
_MATCH = "abs(a.price - b.price) <= greatest(1.0, least(abs(a.price), abs(b.price)) * 0.001)"
PAIRS_SQL = f"""
WITH RECURSIVE assets AS (SELECT p_partkey AS id, p_partkey % 4 AS source, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 50 END AS ident, p_retailprice AS price,
  list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9a-zа-яё]+'), lambda w: length(w) > 1)) AS words FROM part),
found AS (SELECT a.id AS l, b.id AS r FROM assets a JOIN assets b ON a.id < b.id AND a.source <> b.source
  WHERE CASE WHEN a.ident = b.ident THEN NOT {_APART} ELSE {_MATCH} AND len(list_intersect(a.words, b.words)) >= 0.72 * least(len(a.words), len(b.words)) END)"""  # fmt: skip
TIES_SQL = f"""{PAIRS_SQL},
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS n, coalesce(smaller, []) AS smaller FROM (SELECT l AS id FROM found UNION SELECT r FROM found) LEFT JOIN (SELECT r AS id, list(l) AS smaller FROM found GROUP BY r) USING (id)),
scan AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS known UNION ALL SELECT nodes.n, CASE WHEN list_has_any(smaller, known) THEN known ELSE list_append(known, id) END FROM scan JOIN nodes ON nodes.n = scan.n + 1),
ties AS (SELECT id, coalesce(list_min(list_intersect(smaller, known)), id) AS "primary" FROM nodes, (SELECT known FROM scan ORDER BY n DESC LIMIT 1))"""  # fmt: skip


@query("cross_source_pairs", f'{PAIRS_SQL} SELECT l AS "left", r AS "right" FROM found')
def cross_source_pairs(spark, d):
    return resolve.pairs(asset_rows(spark, d))


@query("reconciled_assets", f'{TIES_SQL} SELECT id, "primary" FROM ties')
def reconciled_assets(spark, d):
    return resolve.reconciled(asset_rows(spark, d))


@query("merged_assets", f"""{TIES_SQL},
joined AS (SELECT coalesce(t."primary", p_partkey) AS id, p_partkey AS own, CASE WHEN p_partkey % 3 > 0 THEN p_brand || ' ' || p_name END AS address, p_size FROM part LEFT JOIN ties t ON t.id = p_partkey)
SELECT id, arg_min(address, own) AS address, arg_min(p_size, own)::INTEGER AS p_size, count(*) AS n_sources FROM joined GROUP BY id""")  # fmt: skip
def merged_assets(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(" ").alias("address"), "p_size")
    return resolve.survivors(parts.withColumn("address", F.trim("address")), resolve.reconciled(asset_rows(spark, d)), ["address"])


@query("alike_titles")
def alike_titles(spark, d):
    """Titles of parts of one brand that are alike; SQL has no such ratio, tests compare with all pairs."""
    p = table(spark, d, "part").select("p_brand", F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("lot"), "p_size")).alias("title"))
    return resolve.similar_title_pairs(p, p, ["p_brand"], "title", ordered=True)


@query("sibling_sources", """
SELECT a.doc_id, b.doc_id AS sibling FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source AND a.doc_id < b.doc_id""")
def sibling_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    other = docs.select(F.col("doc_id").alias("sibling"), F.col("source").alias("other"), "k")
    return docs.join(other, "k").where("source <> other AND doc_id < sibling").select("doc_id", "sibling")


@query("token_containment", r"""
WITH t AS (SELECT p_partkey, p_brand, p_size, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[0-9a-zа-яё]+'), lambda w: length(w) > 1)) AS w FROM part)
SELECT a.p_partkey AS left_part, b.p_partkey AS right_part, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 4)::DOUBLE AS containment
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(a.w) > 0 AND len(b.w) > 0""")
def token_containment(spark, d):
    """Names of the same words are one class of a brand and size: each two classes are compared once."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.array_sort(text.tokens("p_name")).alias("words"))
    named, held = classes.classed(p.dropna(subset=["p_brand", "p_size"]).where(F.size("words") > 0), ["p_brand", "p_size", "words"], "p_partkey")
    l, r = (named.select("p_brand", "p_size", F.col("class").alias(s), F.col("words").alias(f"{s}_words")) for s in "lr")
    found = l.join(r, ["p_brand", "p_size"]).where(F.col("l") <= F.col("r")).select("l", "r", F.round(text.shared_share("l_words", "r_words"), 4).alias("containment"))
    told = classes.told(found, held, "containment")
    return told.select(F.col("left").alias("left_part"), F.col("right").alias("right_part"), "containment")


@query("title_similarity")
def title_similarity(spark, d):
    p = table(spark, d, "part")
    l, r = (p.select(F.col("p_partkey").alias(f"{s}_part"), F.col("p_name").alias(f"{s}_name"), "p_brand", "p_size", "p_type") for s in ("left", "right"))
    pairs = l.join(r, ["p_brand", "p_size", "p_type"]).where("left_part < right_part")
    names = pairs.select("left_name", "right_name").distinct()  # each two are compared once
    names = names.withColumn("similarity", F.round(resolve.similarity("left_name", "right_name"), 6))
    return pairs.join(names, ["left_name", "right_name"]).select("left_part", "right_part", "similarity")


@query("identifier_lookup", "SELECT o_orderkey, o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS known FROM orders")
def identifier_lookup(spark, d):
    ids = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("known", F.lit(True))
    return table(spark, d, "orders").join(ids, "o_custkey", "left").select("o_orderkey", F.coalesce("known", F.lit(False)).alias("known"))


@query("set_difference", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))
