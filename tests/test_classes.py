"""Queries on pairs judge classes of equal rows: results against all pairs, and how many rows their joins make on the way."""

import difflib
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lotwright.operators import classes, links, resolve
from lotwright.plans import assets


def joined_rows(df):
    """The rows and the most rows that a join of the plan made, after it has run."""
    rows, most, todo = df.collect(), [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name, made = plan.nodeName(), plan.metrics().get("numOutputRows")
        if "Join" in name and made.isDefined():
            most.append(made.get().value())
        todo += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, max(most)


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_pairs_of_classes_are_those_of_rows(spark):
    rows = [(i, "abc"[i % 3]) for i in range(700)] + [(None, "a"), (5000, "d"), (5000, "e")]
    df = spark.createDataFrame(rows, "id long, of string")
    table, held = classes.classed(df, ["of"])
    found = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("d", "e", 3), ("d", "d", 4)], "l_of string, r_of string, n int")
    named = found.join(table.select(F.col("of").alias("l_of"), F.col("class").alias("l")), "l_of").join(table.select(F.col("of").alias("r_of"), F.col("class").alias("r")), "r_of")
    got = sorted(tuple(r) for r in classes.told(named, held, "n").collect())
    a, b = ([i for i, of in rows if of == x and i is not None] for x in "ab")
    assert got == sorted([(i, j, 1) for i in a for j in a if i < j] + [(min(i, j), max(i, j), 2) for i in a for j in b])


def test_token_containment_compares_equal_names_once(spark, tmp_path):
    names = ["Red ring", "ring red", "red bolt", "red red", "x", None, "old, red ring"]
    rows = [(i, names[i % 7], ["b", "c", None][i % 41 % 3], "T", 1 + i % 2 if i % 50 else None, 900.0) for i in range(600)]
    got, most = joined_rows(assets.token_containment(spark, parts(spark, tmp_path, rows)))
    words = [{w for w in re.findall("[0-9a-z]+", (r[1] or "").lower()) if len(w) > 1} for r in rows]
    want = {
        (a[0], b[0]): round(len(x & y) / min(len(x), len(y)), 4)
        for a, x in zip(rows, words, strict=True) for b, y in zip(rows, words, strict=True)
        if a[0] < b[0] and x and y and a[2] and a[4] and (a[2], a[4]) == (b[2], b[4])
    }
    assert len(got) == len(want) > 10_000 and {(r.left_part, r.right_part): r.containment for r in got} == want
    assert most < 2_000


def test_first_match_asks_once_for_equal_rows(spark):
    rows = [(i, [None, "s", "t", "u"][i % 17 % 4], [None, "x", "y"][i % 3], [100.0, 100.9, 102.0, None, 5000.0][i % 11 % 5]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, source string, identifier string, price double")
    got, most = joined_rows(links.first_match(df.where("id % 2 = 0"), df.where("id % 2 = 1")))
    want = {}
    for f in rows[::2]:
        met = [(0, k[0]) for k in rows[1::2] if None not in (f[1], k[1], f[2]) and f[1] != k[1] and f[2] == k[2] and (None in (f[3], k[3]) or abs(f[3] - k[3]) / max(f[3], k[3], 1) <= 0.05)]
        met += [(1, k[0]) for k in rows[1::2] if None not in (f[1], k[1], f[3], k[3]) and f[1] != k[1] and abs(f[3] - k[3]) <= max(1, 0.001 * min(f[3], k[3]))]
        want[f[0]] = min(met)[1] if met else None
    assert {r.id: r.match for r in got} == want and len(got) == 600 and len(set(want.values())) > 3
    assert most <= 1200


def lots(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, identifiers array<string>, price double, address string, title string, region string")


def alike_lots(n):
    titles = ["Красный дом у реки", "красный дом у реки.", "дом", None, ""]
    return [(i, "aAbc"[i % 4] if i % 97 else None, [["x"], ["x", "y"], None, [], [None]][i % 7 % 5], [100.0, 100.5, 2000.0, None][i // 8 % 4], ["old red ring", "Ring, old", None][i % 8 % 3], titles[i % 50 if i % 50 < 5 else 2], "r" if i % 3 else "") for i in range(n)]


def links_of(rows):
    from tests.test_resolve import expected_pairs

    return expected_pairs([(i, source, [x for x in given or [] if x], *more) for i, source, given, *more in rows if source])


def test_pairs_of_equal_rows_are_told_not_compared(spark):
    rows = alike_lots(400)
    got, most = joined_rows(resolve.pairs(lots(spark, rows)))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == links_of(rows) and len(got) > 10_000
    assert most < 4_000


def test_reconciled_by_classes_is_the_scan_of_rows(spark, monkeypatch):
    from tests.test_resolve import scanned

    rows, given, plain = alike_lots(300), [], resolve.stars
    monkeypatch.setattr(resolve, "stars", lambda found, **more: given.append(found.count()) or plain(found, **more))
    got = resolve.reconciled(lots(spark, rows)).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.primary for r in got} == scanned(links_of(rows))
    assert given[0] < 4_000


def test_reconciled_assets_sees_few_links(spark, tmp_path, monkeypatch):
    given, plain = [], resolve.stars
    monkeypatch.setattr(resolve, "stars", lambda found, **more: given.append(found.count()) or plain(found, **more))
    d = parts(spark, tmp_path, [(i, "red ring", "b", "T", 1, 900.0 + i % 5) for i in range(400)])
    assert {r.id: r.primary for r in assets.reconciled_assets(spark, d).collect()}[6] == 0
    assert max(given) < 1_000


def test_merged_assets_sees_few_links(spark, tmp_path, monkeypatch):
    given, plain = [], resolve.stars
    monkeypatch.setattr(resolve, "stars", lambda found, **more: given.append(found.count()) or plain(found, **more))
    d = parts(spark, tmp_path, [(i, "red ring", "b", "T", 1, 900.0 + i % 5) for i in range(400)])
    merged = assets.merged_assets(spark, d).collect()
    assert sum(r.n_sources for r in merged) == 400 and 1 < len(merged) < 400 and given[0] < 1_000


def test_dense_links_settle_without_components(spark, monkeypatch):
    from tests.test_resolve import scanned

    monkeypatch.setattr(resolve, "components", None)
    edges = {(min(a, b), max(a, b)) for k in range(3) for a in range(k, 300, 6) for b in range(k + 3, 300, 6)} | {(300, 301), (301, 302)}
    got = resolve.stars(spark.createDataFrame(sorted(edges), "left long, right long"), scanned=100).collect()
    assert {r.id: r.primary for r in got} == scanned(edges)


def test_titles_of_few_words_are_told_apart_before_the_ratio(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["large hot blue old cold small", "ring bolt plate gear rod widget", "economy medium promo standard"]
    titles = sorted({" ".join(rnd.choice(w.split()) for w in words) + f" lot {rnd.randrange(50)}" for _ in range(400)})
    df = spark.createDataFrame([(k, t) for k in range(3) for t in titles], "k int, title string")
    near = {(a, b) for a in titles for b in titles if a < b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    got = resolve.similar_title_pairs(df, df, ["k"], "title", ordered=True).collect()
    assert len(got) == 3 * len(near) > 300 and {(r.l_title, r.r_title) for r in got} == near
    monkeypatch.setattr(resolve, "_reaches", lambda a, b: F.lit(True))
    reached = resolve.similar_title_pairs(df, df, ["k"], "title").where("l_title < r_title").count() / 3
    assert reached < 0.05 * len(titles) ** 2 / 2


def test_no_title_that_reaches_the_ratio_is_ruled_out():
    rnd, a, b = random.Random(6), [], []
    for _ in range(2000):
        said = "".join(rnd.choice("abcdeя \0"[: rnd.choice([3, 7, 8])]) for _ in range(rnd.choice([1, 2, 20, 40, 63, 64, 65, 70])))
        other = list(said)
        for _ in range(rnd.randrange(7)):
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
        a, b = [*a, said], [*b, "".join(other)]
    may = resolve._may_reach(pd.Series(a), pd.Series(b))
    reach = [difflib.SequenceMatcher(None, x, y).ratio() >= 0.92 for x, y in zip(a, b, strict=True)]
    assert all(m or not r for m, r in zip(may, reach, strict=True)) and 0 < sum(~may) and sum(may) < sum(reach) + 400
