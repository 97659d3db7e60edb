"""Removal of lines that stand on many sites.

Lines are hashed; a line's sites are counted by a HyperLogLog sketch for each line hash, which Spark builds in every
task and merges, so a line that a third of all documents hold is no one's burden. Where a sketch's estimate is within
BAND of the threshold, sites are counted exactly. Every (line, site) of every row counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
#: Size of a sketch: 2**12 registers, of which the standard error is 1.6 %.
LG_K = 12
#: Counts this near to the threshold, as a share of it and at least 2, are made exactly: over ten standard errors.
BAND = 0.2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A line's 128-bit hash, without spaces at its ends."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def _spread(rows: DataFrame, value: str, least: int) -> DataFrame:
    """The keys of rows (key, value) that have at least so many distinct values."""
    rough = common.stage(rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(LG_K))).alias("some"), F.count(F.lit(1)).alias("n")), "lines")
    band = max(2.0, BAND * least)
    near = rough.where(F.abs(F.col("some") - least) <= band).select("key", "n")
    exact = common.semi_join(rows, near, ["key"]).groupBy("key", value).agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("some")).where(F.col("some") >= least)
    return rough.where(F.col("some") > least + band).select("key").union(exact.select("key"))


def widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_texts: int = 1, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Rows (key, n): the hashes of lines that stand on min_sites sites or more and in min_texts different texts or more; n rows hold one.

    Blank lines are never counted. A null site is a site of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Hashed below the explode, not once for each line.
    each = docs.select(F.xxhash64(text).alias("t"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.array_distinct(_lines(text)).alias("lines"))
    held = each.select("t", "site", F.explode("lines").alias("line")).where(F.trim("line") != "").select(_key(F.col("line")).alias("key"), "site", "t")
    # Fewer rows than min_sites cannot be on so many sites: most lines need no sketch.
    often = common.stage(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(min_sites, min_texts)), "lines")
    some = common.stage(common.semi_join(held, often, ["key"]), "lines")
    wide = common.stage(_spread(some, "site", min_sites), "lines")
    if min_texts > 1:
        within = common.stage(common.semi_join(some, often.join(wide, "key"), ["key"]), "lines")
        wide = common.stage(_spread(within, "t", min_texts), "lines")
        common.drop(within)
    found = common.stage(often.join(wide, "key"), "lines")
    common.drop(often, some, wide)
    return found


def remove_widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_texts: int = 1, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with its text's widespread lines taken out, and columns n_lines and n_removed added at the end.

    A line is widespread if it stands on min_sites sites and, where min_texts is more than 1, in so many different texts,
    which keeps a mirrored document's own lines. Lines end at \\n; compared without spaces at their ends. A null text
    stays null, has no lines and loses none; an empty text is one blank line. Lines that stay are joined by \\n unchanged.
    All columns stay, but any that are named n_lines or n_removed, which are replaced.
    """
    docs = common.without(docs, "n_lines", "n_removed")
    _t, _gone, _kept = common.fresh(docs, "_t", "_gone", "_kept")
    known = _key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    placed = docs.where(F.col(text_col).isNotNull()).select(known.alias("t"), _lines(F.col(text_col)).alias("lines")).select("t", F.posexplode("lines").alias("place", "line"))
    placed = placed.where(F.trim("line") != "").select(_key(F.col("line")).alias("key"), "t", "place")
    found = common.semi_join(placed, widespread_lines(docs, min_sites, min_texts, text_col, site_col), ["key"])
    places = F.array_sort(F.collect_set("place"))
    # A flag for each line up to the last that goes, so that each line is looked up once: stay as often as lines lie between, then go.
    between = lambda p, q: F.when(p.isNull(), F.array().cast("array<boolean>")).otherwise(F.concat(F.array_repeat(F.lit(True), p - q - 1), F.array(F.lit(False))))
    flags = F.flatten(F.zip_with(places, F.concat(F.array(F.lit(-1)), places), between))
    gone = found.groupBy("t").agg(flags.alias(_gone)).withColumnRenamed("t", _t)
    # Copies of one text may be a third of all rows; what tells them apart is any column but the text.
    apart = [c for c, kind in docs.dtypes if c != text_col and not {"map", "variant"} & set(re.findall(r"\w+", kind))]
    hashed = docs.withColumn(_t, known)
    joined = common.dealt_join(hashed, gone, _t, "left", hashed.select(_t), apart)
    lines = _lines(F.col(text_col))
    out = joined.withColumn(_kept, F.when(F.col(_gone).isNull(), lines).otherwise(F.filter(lines, lambda x, j: F.coalesce(F.get(F.col(_gone), j), F.lit(True)))))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(_kept)).cast("long")
    text = F.when(F.col(_gone).isNull(), F.col(text_col)).otherwise(F.array_join(_kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lines, lines removed, code points left, and the digest of the text left."""
    cut = remove_widespread_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    text = F.coalesce("text", F.lit(""))
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


#: For other table names, format with docs.
KEPT_SQL = """
SELECT d.*, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(g.gone, trim(x, ' '))), chr(10)), '') END AS text_left,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(g.gone, trim(x, ' ')))) END AS n_removed
FROM {docs} d, (
  SELECT coalesce(list(line), []) AS gone FROM (
    SELECT line FROM (SELECT trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS line, coalesce(source, '') AS site FROM {docs})
    WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10)) g
"""

OP9_SQL = f"""
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(coalesce(text_left, '')) AS n_chars_left, sha256(coalesce(text_left, '')) AS text_sha256
FROM ({KEPT_SQL.format(docs="documents")})
"""
