import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotwright.llm import substring


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def check(spark, texts, window):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, t1 int")
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated_spans(df, window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_random_texts_with_planted_repeats(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    common = [" ".join(rnd.choices(vocab, k=rnd.randint(35, 90))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(rnd.choice(common) if rnd.random() < 0.4 else " ".join(rnd.choices(vocab, k=rnd.randint(1, 60))))
        texts.append("\n ".join(parts))
    texts += [texts[0], texts[1], None, "", " \t", "a " * 300, "a b " * 200, "a " * 40, "b " * 34, "b " * 34, "ü x \x1f y"]
    check(spark, texts, 35)


def test_small_alphabet_has_runs_and_periods(spark):
    rnd = random.Random(8)
    check(spark, [" ".join(rnd.choices("ab", k=rnd.randint(0, 400))) for _ in range(25)] + [" ".join(["a"] * k) for k in (34, 35, 36, 90)], 35)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(4)
    for size in (2, 3, 1000):
        texts = [" ".join(str(rnd.randrange(size)) for _ in range(3000)) for _ in range(2)]
        shared = " ".join(str(rnd.randrange(size)) for _ in range(70))
        texts = [f"{t} {shared} {t[::-1]}" for t in texts]
        p = substring.Parsed(pa.array(texts))
        _, name = p.anchors()
        seen = {}
        for b, r, m in zip(p.begin.tolist(), p.row.tolist(), name.tolist(), strict=True):
            key = tuple(p.words[b : b + 35].tolist())
            assert seen.setdefault(key, m) == m
    assert len(np.unique(name)) < len(name) / 6


def test_driver_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    import hashlib

    want = {r.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for r, (n, k, t) in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op3_substring_dedup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("texts", [[]])
def test_empty_table(spark, texts):
    check(spark, texts, 35)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + " end"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring.remove_repeated_spans(df).collect())
    assert got == [(0, 0), (50, 50), (50, 50), (51, 50)]


def test_words_that_defeat_polynomials_modulo_a_power_of_two(spark):
    for k in (10, 11, 12):
        bits = [bin(i).count("1") & 1 for i in range(1 << k)]
        first, second = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
        tail = " ".join(f"w{i}" for i in range(34))
        check(spark, [f"{first} {tail}", f"{second} {tail}"], 35)


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400_000)]
    passage = words[1000:1050]
    check(spark, [" ".join(words + passage), " ".join(passage), "x" * 5_000_000 + " y"], 35)


def test_hot_windows_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring.common, "HOT_SHARE", 1e-9)
    passage = " ".join(f"p{i}" for i in range(60))
    check(spark, [f"own{i} {passage} end{i}" for i in range(1500)], 35)


@pytest.mark.parametrize("size", [64, 700])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", [f"word{i}" for i in range(500)]])
def test_long_texts_by_slices_are_judged_alike(size, alphabet, monkeypatch):
    rnd = random.Random(size)
    monkeypatch.setattr(substring, "SLICE_BYTES", size)
    for n in (1, 34, 35, 36, 200, 1500):
        text = rnd.choice(["", " ", "\n"]) + "".join(w + rnd.choice([" ", "  ", "\t"]) for w in rnd.choices(alphabet, k=n)) + rnd.choice(["", "y" * 300])
        data = np.frombuffer(text.encode(), np.uint8)
        p = substring.Parsed(pa.array([text]))
        place, name = p.anchors()
        assert sorted(substring._long_anchors(data, 35).tolist()) == sorted(m for _, m in set(zip(place.tolist(), name.tolist(), strict=True)))
        known = np.unique(name[::3])
        for whole in (False, True):
            at = np.arange(len(name)) if whole else np.flatnonzero(np.isin(name, known))
            for got, want in zip(substring._long_windows(data, 35, known, whole), (p.begin[at], *p.hashes(at)), strict=True):
                assert got.tolist() == want.tolist()
        words = text.split()
        for begins, copied in ((np.zeros(0, np.int64), False), (np.arange(0, max(0, len(words) - 34), 50), False), (np.zeros(0, np.int64), True)):
            gone = {b + k for b in begins.tolist() for k in range(35)} | set(range(len(words)) if copied and len(words) >= 35 else ())
            stay = " ".join(w for i, w in enumerate(words) if i not in gone).encode()
            assert substring._long_cut(data, 35, begins, copied) == (len(words), len(gone), stay)


def test_memory_grows_little_with_a_text():
    rnd = random.Random(5)
    data = np.frombuffer(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(2_000_000)).encode(), np.uint8)
    peaks = []
    for part in (data[: 2 << 20], data[: 4 << 20], data):  # the first run makes tables of powers
        tracemalloc.start()
        known = substring._long_anchors(part, 35)[:1000]
        begin, *_ = substring._long_windows(part, 35, known, False)
        substring._long_cut(part, 35, begin, False)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # beside a slice's, some bytes for each byte of the text; 48 if all of it is parsed at once
    assert peaks[2] - peaks[1] < 6 * (len(data) - (4 << 20))
