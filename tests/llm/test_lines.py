from collections import defaultdict

import duckdb
import pytest
from pyspark.sql.functions import lit

from lotwright.llm import lines


def brute(rows, min_sites, min_texts=1):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" ")].add(s or "")
            texts[x.strip(" ")].add(t or "")
    gone = {x for x, s in sites.items() if x and len(s) >= min_sites and len(texts[x]) >= min_texts}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone)) for i, t, _ in rows]


def test_driver_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(lines.OP9_SQL).fetchall())
    got = sorted(tuple(r) for r in lines.op9_line_dedup(spark, sf).collect())
    assert got == want and any(r[2] for r in got)


@pytest.mark.parametrize(("min_sites", "min_texts"), [(2, 1), (3, 1), (40, 1), (3, 2), (40, 40), (2, 60)])
def test_against_brute_force(spark, min_sites, min_texts):
    rows = [(i, f"own {i}\n  shared \n\nby {i % 3}\nlast {i % 30}", f"s{i % 45}") for i in range(90)]
    rows += [(100 + i, "mirror\nof one", f"s{i}") for i in range(44)]
    rows += [(200, None, "s1"), (201, "", None), (None, "shared", "s2"), (202, "shared\n" * 3000, "s3"), (202, "x\nmirror", None), (202, "x\nmirror", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, key string").withColumn("N_LINES", lit(7)).withColumn("_gone", lit(1))
    got = lines.remove_widespread_lines(df, min_sites, min_texts)
    assert got.columns == ["doc_id", "text", "source", "key", "_gone", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, min_sites, min_texts), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.remove_widespread_lines(df).collect() == []


def test_a_notice_that_stands_alone_on_many_sites_is_found(spark):
    rows = [(i, "all rights", f"s{i}") for i in range(30)] + [(40, "own text\nall rights\nmore", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_widespread_lines(df).collect()}
    assert got == {i: ("", 1) for i in range(30)} | {40: ("own text\nmore", 1)}


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 7}" if i % 3 else f"own {i}" for i in range(300_000))
    rows = [(i, "\n".join(f"line {k}" for k in range(7)), f"s{i}") for i in range(12)] + [(99, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = lines.remove_widespread_lines(df).where("doc_id = 99").first()
    assert (r.n_lines, r.n_removed) == (300_000, 200_000) and r.text == "\n".join(f"own {i}" for i in range(0, 300_000, 3))


def test_a_hot_line_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines.common, "HOT_SHARE", 1e-9)
    rows = [(i, f"hot\nown {i}", f"s{i % 12}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.text for r in lines.remove_widespread_lines(df).collect()} == {f"own {i}" for i in range(3000)}
