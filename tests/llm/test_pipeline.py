from collections import defaultdict

import pytest

import corpus_pipeline as cp
from lotwright.llm import packing

from .test_decontamination import brute_best
from .test_lines import brute as brute_lines
from .test_simhash import similar


def test_stages_on_the_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        before = docs.collect()
        after = stage(spark, docs, sf)
        if name == "best-fit packing":
            rows = after.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            break
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.columns == list(cp.COLUMNS)
        rows = after.collect()
        ids = {r.doc_id for r in rows}
        if name == "line dedup":
            want = dict(brute_lines([(r.doc_id, r.text, r.source) for r in before], 10, 10))
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "SimHash near-dedup":
            before.sort(key=lambda r: r.doc_id)
            want = {before[c].doc_id for c in similar([r.text for r in before])}
            assert want <= ids and len(rows) == len(ids)  # no document goes without cause
            assert len(before) - len(ids) >= 0.95 * (len(before) - len(want))
        elif name == "benchmark decontamination":
            items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaking = {r.doc_id for r in before if any(len(set(i) & set(r.text.lower().split())) >= 0.5 * len(set(i)) and brute_best(i, r.text.lower().split()) <= (len(i) * 2) // 10 for i in items)}
            assert ids == {r.doc_id for r in before} - leaking
        docs = after


def test_run_gives_whole_sequences(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert cp.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "A B C", "en", "t", 5)]])
def test_odd_rows(spark, sf, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "clash") for r in rows], schema + ", _score string")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name == "SimHash near-dedup" and rows:
            assert {r.doc_id for r in got} == {1, 2} and len(got) == 2
        docs = spark.createDataFrame(got, out.schema)


def test_unlike_rows_with_null_and_repeated_ids_all_stay(spark, sf):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdefg"]
    near = texts[6] + " end"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (0, texts[5]), (None, texts[5] + " end"), (7, near), (8, texts[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([*((None, t) for t in texts[:3]), (7, texts[3]), (7, texts[4]), (0, texts[5]), (7, near)], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 0), (3, 0)], [(i, 1) for i in range(30)], [(i, i % 2) for i in range(30)]])
def test_few_labels_reject_nothing(spark, tmp_path, labels):
    words = ["sun", "moon", "tree", "lake", "road"]
    rows = [(i, f"{words[i % 5]} {i * 7919 % 1000}", "en", "s", 8) for i in range(30)] + [(None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)
