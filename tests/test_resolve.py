"""Components, the scan by id, and pairs of the same asset, against brute force."""

import difflib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwright.operators import components, resolve


def scanned(edges):
    partners, primary = defaultdict(set), {}
    for a, b in edges:
        partners[b].add(a)
    for i in sorted({x for e in edges for x in e}):
        primary[i] = min((a for a in partners[i] if primary[a] == a), default=i)
    return primary


def tied(spark, edges, **more):
    return {r.id: r.primary for r in resolve.stars(spark.createDataFrame(sorted(edges), "left long, right long"), **more).collect()}


def test_components_of_any_graph(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(-40, 200), rnd.randrange(-40, 200)) for _ in range(150)] + [(7, 7), (900, 901)] + [(2**60, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 4), (5, None)], "left long, right long")
    assert {r.node: r.component for r in components.components(df).collect()} == {x: find(x) for x in root}
    assert components.components(df.limit(0)).collect() == []


def test_chain_settles_in_few_rounds(spark, monkeypatch):
    written, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: written.append(1) or plain(self, *a, **k))
    ids = list(range(10_000))
    random.Random(1).shuffle(ids)
    edges = {(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False)} | {(i, i + 1) for i in range(20_000, 30_000)}
    assert tied(spark, edges) == scanned(edges)
    assert len(written) < 2 * 20  # two tables a round


@pytest.mark.parametrize("most", [200_000, 10, 0])
def test_stars_are_those_of_the_scan(spark, most):
    rnd = random.Random(most)
    edges = {(a, b) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(130)) if a < b} | {(200, x) for x in range(201, 240)}
    assert tied(spark, edges, scanned=most) == scanned(edges)


def test_no_links(spark):
    assert resolve.stars(spark.createDataFrame([], "left long, right long")).collect() == []


WORDS = ["нежилое", "здание", "помещение", "на", "улице", "мира", "склад", "участок", "земельный", "дом", "номер", "7", "12", "ленина", "свободы"]


def drawn(rnd, n):
    def title():
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 7))]
        return " ".join(words) + rnd.choice(["", ".", "..", "а"])

    pool = [title() for _ in range(n // 4)]
    rows = []
    for i in range(n):
        said = rnd.choice(pool)
        at = rnd.randrange(len(said))
        said = rnd.choice([said, said[:at] + said[at + 1 :], said[:at] + "ж" + said[at:], title()])
        rows.append((i, rnd.choice("aAbc"), [rnd.choice("xyz")] if rnd.random() < 0.1 else [], rnd.choice([100.0, 100.5, 2000.0, 2001.5, 5e6, 5e6 + 4000, None]), rnd.choice([title(), said, "", None]), said, rnd.choice(["r", "q", "", None])))
    return rows


def expected_pairs(rows):
    tokens = lambda s: [w for w in dict.fromkeys(re.findall("[0-9a-zа-яё]+", (s or "").lower())) if len(w) > 1 and w not in resolve.text.COMMON_ADDRESS_WORDS]
    found = set()
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or a[1].lower() == b[1].lower():
                continue
            shared = bool(set(a[2]) & set(b[2]))
            if shared:
                if a[3] is None or b[3] is None or abs(a[3] - b[3]) / max(a[3], b[3], 1) <= 0.05:
                    found.add((a[0], b[0]))
                continue
            if a[3] is None or b[3] is None or abs(a[3] - b[3]) > max(1, 0.001 * min(a[3], b[3])):
                continue
            x, y = set(tokens(a[4])), set(tokens(b[4]))
            long = len(tokens(a[5])) >= 3 and len(tokens(b[5])) >= 3 and a[6] == b[6] and a[6]
            if x and y and len(x & y) >= 0.72 * min(len(x), len(y)) or long and difflib.SequenceMatcher(None, a[5].lower(), b[5].lower()).ratio() >= 0.92:
                found.add((a[0], b[0]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_all_pairs(spark, seed):
    rows = drawn(random.Random(seed), 240)
    df = spark.createDataFrame(rows, "id long, source string, identifiers array<string>, price double, address string, title string, region string")
    got = [tuple(r) for r in resolve.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_pairs(rows) and len(got) > 50


def test_alike_titles_are_those_of_all_pairs_and_few_are_compared(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("абвгдежзиклмно ") for _ in range(rnd.randint(4, 60))) for _ in range(150)]
    titles = set(base)
    for t in base:
        for _ in range(3):
            at = rnd.randrange(len(t))
            titles.add(rnd.choice([t[:at] + "я" + t[at:], t[:at] + t[at + 1 :], t[:at] + "я" + t[at + 1 :], t[at:] + t[:at]]))
    titles = sorted(titles)
    compared, plain = [], resolve._reaches
    monkeypatch.setattr(resolve, "_reaches", lambda a, b: compared.append(1) or plain(a, b))
    df = spark.createDataFrame([(1, t) for t in titles for _ in range(2)], "k int, title string")
    got = {(r.l_title, r.r_title) for r in resolve.similar_title_pairs(df, df, ["k"], "title").collect()}
    want = {(a, b) for a in titles for b in titles if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert got == want and len(want) > 200 and compared
    # What reaches the comparison: the same plan with a comparison that says yes to all.
    monkeypatch.setattr(resolve, "_reaches", lambda a, b: F.lit(True))
    assert resolve.similar_title_pairs(df, df, ["k"], "title").count() < 0.1 * len(titles) ** 2


def test_order_of_strings_is_one_for_all_rows(spark):
    rows = [(i, ["the", f"w{i}", f"v{i % 40}"]) for i in range(3000)]
    got = resolve.rare_first(spark.createDataFrame(rows, "id int, held array<string>"), "held").collect()
    assert all(r.held[-1] == "the" and r.held[0] == f"w{r.id}" for r in got)
