import random

import numpy as np
import pyarrow as pa
import pytest

from lotwright.llm import decontamination as dec


def brute_best(item, words):
    """The least edit distance between the item and any run of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(words, k, vocab, rnd):
    words = list(words)
    for _ in range(k):
        i = rnd.randrange(len(words))
        how = rnd.randrange(3)
        if how == 0:
            words[i] = rnd.choice(vocab)
        elif how == 1:
            del words[i]
        else:
            words.insert(i, rnd.choice(vocab))
    return words


def test_best_match_is_exact():
    rnd = random.Random(1)
    for _ in range(200):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 9))]
        region = [rnd.randrange(4) for _ in range(rnd.randint(1, 20))]
        d, s, e = dec.best_match(np.array(item, np.uint64), np.array(region, np.uint64))
        assert d == brute_best(item, region)
        assert brute_best(item, region[s:e]) == d


def test_recall_and_precision_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["the", "of", "to", "and"] * 30 + [f"w{i}" for i in range(500)]
    items = [rnd.choices(vocab[120:] if n < 6 else vocab, k=n) for n in (1, 2, 3, 4, 5, *(rnd.randint(6, 60) for _ in range(25)))]
    docs, want = [], 0
    for i in range(250):
        base = rnd.choices(vocab, k=rnd.randint(0, 200))
        if i % 2:
            item = rnd.choice(items)
            at = rnd.randint(0, len(base))
            base[at:at] = edit(item, rnd.randint(0, len(item) // 4), vocab, rnd)
        docs.append(" ".join(base))
    truth = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            if brute_best(item, text.split()) <= dec.allowed(len(item), 0.8):
                truth.add((d, i))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)], "item_id long, text string")
    rows = dec.find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= truth and len(got) >= 0.98 * len(truth) and len(truth) > 60
    for r in rows:
        words = docs[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
        assert brute_best(items[r.item_id], words) <= r.distance
    kept = {r.doc_id for r in dec.drop_leaking(df, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}


def test_blocks_give_the_same_rows(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(dec.find_leaks(docs, bench).collect())
    monkeypatch.setattr(dec, "BLOCK_WORDS", 400)
    assert sorted(dec.find_leaks(docs, bench).collect()) == whole
    texts = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in " ".join(r.text.lower().split())}
    assert {(r.doc_id, r.item_id) for r in whole if r.distance == 0} >= exact


@pytest.mark.parametrize("docs", [[], [(1, None), (2, ""), (None, "a b c d e f g"), (3, "x " * 50_000 + "A b\nc d e f g"), (3, "a b c d e"), (3, "a b c d e")]])
def test_odd_rows(spark, docs):
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (None, " a b\nc d e f g"), (3, "y"), (4, ""), (5, "B C"), (5, "b c")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.distance) for r in dec.find_leaks(df, bench).collect()), key=str)
    want = [(d, i, s, 0) for d, s in ((3, 50_000), (None, 0)) for i in (1, None)] + [(d, 5, s, 0) for d, s in ((3, 50_001), (None, 1), (3, 1), (3, 1)) for _ in range(2)]
    assert got == (sorted(want, key=str) if docs else [])
    assert dec.find_leaks(df, bench.limit(0)).collect() == []
    assert len(dec.drop_leaking(df, bench).collect()) == max(0, len(docs) - 4)


def test_only_what_shares_a_bucket_is_found(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"so {item} end"), (2, item.replace("four", "vier"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in dec.find_leaks(df, bench).collect()} == {1, 2}
    index = dec.Index.build([((1, 1), item)])
    assert not list(dec.Index.build([((1, 1), item.replace("e", "q"))]).candidates(*dec.normal_words(pa.array([item]))))
    index.buckets = {m: (k ^ np.uint64(1), of) for m, (k, of) in index.buckets.items()}
    assert not index.matches(*dec.normal_words(pa.array([item])))


def test_keys_are_those_of_walks():
    rnd = np.random.RandomState(3)
    rows = rnd.randint(0, 5, (6, 9)).astype(np.uint64)
    rows[1] = rows[0]
    got = dec.keys(rows, 5, 2)
    assert (got[:, 0] == got[:, 1]).all()
    places = np.random.RandomState(9)
    sampled = [sorted(places.choice(27, 2, replace=False)) for _ in range(5)]
    for r in range(5):
        seed = dec.mix(np.array([r + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for n in range(6):
            at, key = 0, dec.mix(seed)
            for j in range(27):
                word = np.array([rows[n][at]]) if at < 9 else np.array([dec._PAD])
                if j in sampled[r]:
                    key = dec.mix(key * np.uint64(31) + word)
                at = min(9, at + int(dec.mix(word ^ (seed + np.uint64(j * 0x632BE5AB & 0xFFFFFFFF)))[0] >> np.uint64(63)))
            assert got[r, n] == key[0]


def test_words_are_lower_cased():
    words, first = dec.normal_words(pa.array(["ÄB c", None, "äb C"]))
    assert words[0] == words[2] and words[1] == words[3] and first.tolist() == [0, 2, 2, 4]
