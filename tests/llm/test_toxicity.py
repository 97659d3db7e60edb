import math
import random
import zlib

import numpy as np
import pytest

from lotwright.llm import toxicity


def brute_features(text, n):
    t = f" {' '.join((text or '').lower().split())} "
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def test_features_are_the_distinct_ngrams():
    of = toxicity.Features(bits=22)
    for text in ("", None, "Ab ab\nAB ab", "ünïcode 日本 " * 50, "\ud800 x"):
        assert abs(len(of(text)) - sum(len(brute_features(text, n)) for n in toxicity.SIZES)) <= 1
    assert np.array_equal(np.sort(of("You  CLOWN")), np.sort(of("you clown")))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.op8_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    hits = sum(p and y for p, y in test)
    assert sum(p == y for p, y in test) / len(test) > 0.93
    assert hits / max(1, sum(p for p, _ in test)) > 0.8 and hits / sum(y for _, y in test) > 0.5


def plain_ratios(rows):
    """Log-count ratios of the n-grams themselves, which are not hashed."""
    sizes = [sum(y == k for _, y in rows) for k in (0, 1)]
    count = {}
    for text, y in rows:
        for g in set().union(*(brute_features(text, n) for n in toxicity.SIZES)):
            count.setdefault(g, [0, 0])[y] += 1
    out = {}
    for g, (good, bad) in count.items():
        r = math.log((bad + 1) / (sizes[1] + 2)) - math.log((good + 1) / (sizes[0] + 2))
        out[g] = r if good + bad >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO else 0.0
    return out


def test_ratios_and_scores_against_a_plain_version(spark):
    rnd = random.Random(2)
    words = ["sun", "moon", "tree", "lake", "road", "idiot", "scum"]
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        # what is toxic stands after 30,000 code points in some texts: whole texts are learnt from
        text = " ".join(rnd.choices(words[:5], k=8)) + (" calm" * 6000 if i % 20 == 0 else "") + (f" {rnd.choice(words[5:])}" if bad else "")
        rows.append((i, text, int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learnt = [(t, y) for i, t, y in rows if not toxicity.held_out(i)]
    want = plain_ratios(learnt)
    of = toxicity.Features()
    ratio = toxicity.log_count_ratios(toxicity.training_rows(docs, labels))
    for text, _ in learnt[::7]:
        grams = set().union(*(brute_features(text, n) for n in toxicity.SIZES))
        assert np.isclose(ratio[of(text)].sum(), sum(want[g] for g in grams), atol=1e-6)
    assert max(want.values()) > 1.5
    # The weights minimise the penalised, class-balanced loss of the scaled features: the gradient is small.
    weight, constant = toxicity.fit(docs, labels)
    used = np.flatnonzero(ratio)
    x = np.array([[ratio[k] if k in have else 0.0 for k in used] for have in (set(of(t).tolist()) for t, _ in learnt)])
    y = np.array([k for _, k in learnt])
    w = weight[used] / ratio[used]
    p = 1 / (1 + np.exp(-(x @ w + constant)))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    start = x.T @ (balance * (0.5 - y))
    assert np.abs(x.T @ (balance * (p - y)) + toxicity.PENALTY * w).max() < 0.2 * np.abs(start).max()
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for i, t, _ in rows[::11]:
        assert np.isclose(got[i], 1 / (1 + math.exp(-(weight[of(t)].sum(dtype=float) + constant))))
    assert all((got[i] >= 0.5) == bool(k) for i, _, k in rows)


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 7 + 1, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] * 3, "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sum(not toxicity.held_out(i) for i in range(1, 8))
    assert toxicity.training_rows(docs, labels, 2).count() == 2


def test_learns_nothing_from_held_out_rows(spark):
    out = [i for i in range(200) if toxicity.held_out(i)]
    docs = spark.createDataFrame([(i, f"good text {i}" if i not in out else "bad") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in out)) for i in range(200)], "doc_id long, toxic int")
    weight, constant = toxicity.fit(docs, labels)
    assert not weight.any() and constant < 0


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "x"), (2, ""), (2, ""), (3, "idiot " * 4000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, predicted int, score double")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in empty} <= {0.5}
