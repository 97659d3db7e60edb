import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lotwright.llm import fingerprint as fp


def phrases(text):
    """The last level's names in order, without their places."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return [x[0].tolist() for x in fp.names(raw, np.array([0, len(raw)]))][-1] if len(raw) else []


def text(rnd, n, alphabet="abcdefghij \n"):
    return "".join(rnd.choices(alphabet, k=n))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "aaaaab", "äöü日本"])
def test_equal_substrings_share_interior_names(alphabet):
    rnd = random.Random(7)
    for _ in range(20):
        shared = text(rnd, 2000, alphabet)
        a = phrases(text(rnd, rnd.randint(0, 300), alphabet) + shared + text(rnd, 100, alphabet))
        b = phrases(text(rnd, rnd.randint(0, 300), alphabet) + shared)
        inner = phrases(shared)
        # all but a bounded number at either end
        core = inner[12:-12]
        where = lambda x: any(x[i : i + len(core)] == core for i in range(len(x)))
        assert len(core) > 3 and where(a) and where(b)


def test_phrases_are_bounded():
    rnd = random.Random(1)
    s = text(rnd, 30_000)
    assert 30_000 / 130 < len(phrases(s)) < 30_000 / 8
    assert len(phrases("a" * 10_000)) == 1 and len(phrases("ab" * 5000)) >= 1 and phrases("") == []


def test_batches_do_not_matter():
    rnd = random.Random(2)
    texts = [text(rnd, rnd.choice([0, 1, 2, 3, 10, 500, 4000])) for _ in range(60)] + ["", "a", "aa", "aaa", None]
    alone = [fp.as_text(fp.fingerprint_texts(pa.array([t], pa.string()))[0]) for t in texts]
    assert [fp.as_text(x) for x in fp.fingerprint_texts(pa.array(texts, pa.string()))] == alone


@pytest.mark.parametrize("block", [16, 300])
def test_long_texts_by_blocks_are_parsed_alike(block, monkeypatch):
    rnd = random.Random(block)
    texts = [text(rnd, n, a) for a in ("ab", "abcdefghij ", "aaaaab", "äöü日本") for n in (1, 2, 3, 4, 17, 900, 5000)]
    texts += ["a" * 4000, "ab" * 3000, text(rnd, 700) * 6, "x" + "a" * 900 + text(rnd, 50) + "abc" * 800, text(rnd, 2000) + "z" * 2500]
    whole = [fp.as_text(x) for x in fp.fingerprint_texts(pa.array(texts))]
    monkeypatch.setattr(fp, "BLOCK_BYTES", block)
    assert [fp.as_text(fp.long_sketch(np.frombuffer(t.encode(), np.uint8))) for t in texts] == whole
    mixed = [*texts[:9], "", None, *texts[9:]]
    got = [fp.as_text(x) for x in fp.fingerprint_texts(pa.array(mixed, pa.string()))]
    assert got == [*whole[:9], "", "", *whole[9:]]


@pytest.mark.parametrize("unit", [None, "a", "abc"])
def test_memory_does_not_grow_with_a_text(unit):
    rnd = np.random.RandomState(3)
    n = 12 << 20
    data = rnd.choice(np.frombuffer(b"abcdefghij \n", np.uint8), n) if unit is None else np.frombuffer((unit * n)[:n].encode(), np.uint8)
    fp.long_sketch(data[: fp.BLOCK_BYTES])  # tables of powers
    tracemalloc.start()
    fp.long_sketch(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def coin(x, y):
    """y's label after x: the lowest place where they differ, and y's bit there."""
    k = ((x ^ y) & -(x ^ y)).bit_length() - 1
    return 0 if x == y else 2 * k + (y >> k & 1)


def plain_phrases(raw):
    """The phrases of all levels of a text as byte strings, by the definition, symbol by symbol."""
    symbols, out = [(b, raw[i : i + 1]) for i, b in enumerate(raw)], []
    for level in range(fp.LEVELS):
        runs = []
        for name, spelt in symbols:
            if runs and runs[-1][0] == name:
                runs[-1] = (name, runs[-1][1] + spelt, runs[-1][2] + 1)
            else:
                runs.append((name, spelt, 1))
        kept = [(name if level == 0 or n == 1 else int(fp.mix(np.array([(name + n) % 2**64], np.uint64))[0]), spelt) for name, spelt, n in runs]
        labels = [name for name, _ in kept]
        for toss in range(3 if level == 0 else 5):
            first = 0 if level and toss == 0 else labels[0] & 1
            labels = [first] + [coin(a, b) for a, b in zip(labels, labels[1:], strict=False)]
        starts = [i for i in range(len(kept)) if i == 0 or 1 < i < len(kept) - 1 and labels[i - 1] < labels[i] >= labels[i + 1]]
        spelt = [b"".join(x for _, x in kept[a:b]) for a, b in zip(starts, [*starts[1:], len(kept)], strict=True)]
        data = np.frombuffer(b"".join(spelt), np.uint8)
        at = np.cumsum([0] + [len(x) for x in spelt])
        names = fp.Spans(fp.common.BYTE[data], 3)(at[:-1], at[1:]).tolist()
        symbols = list(zip(names, spelt, strict=True))
        out.append(symbols)
    return out


def plain_fingerprint(text):
    if not text:
        return []
    found = {int(fp.ranks(np.array([name], np.uint64), level)[0]) for level, symbols in enumerate(plain_phrases(text.encode()), 1) for name, _ in symbols}
    return sorted(found)[: fp.KEPT]


def plain_likeness(a, b):
    least = sorted(set(a) | set(b))[: fp.KEPT]
    return sum(x in set(a) & set(b) for x in least) / len(least) if least else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain_fingerprint(x) for x in (t, e, nxt))
        show = lambda x: "".join(f"{r:010x}" for r in x)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), show(a), show(b), plain_likeness(a, b), plain_likeness(a, c))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "aaaaab", "äöü日本"])
def test_phrases_are_those_of_coin_tossing(alphabet):
    rnd = random.Random(4)
    for n in (1, 2, 3, 4, 7, 40, 900):
        raw = text(rnd, n, alphabet).encode()
        got = list(fp.names(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        for (names, begins, _), want in zip(got, plain_phrases(raw), strict=True):
            assert [raw[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(raw)], strict=True)] == [x for _, x in want]
            assert names.tolist() == [x for x, _ in want]


def test_short_texts_that_share_half_are_told():
    rnd = random.Random(6)
    for n, least in ((20, 0.1), (50, 0.2), (100, 0.25), (1000, 0.25), (20_000, 0.25)):
        near, far = [], []
        for _ in range(40):
            a, b = text(rnd, n, "abcdefghijklmnopqrstuvwxyz     "), text(rnd, n, "abcdefghijklmnopqrstuvwxyz     ")
            x, y, z = fp.fingerprint_texts(pa.array([a, a[: n - n // 2] + b[: n // 2], b]))
            near.append(fp.likeness(x, y))
            far.append(fp.likeness(x, z))
        assert np.mean(near) > least and np.mean(far) < 0.06


def test_driver_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = fp.op6_document_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)
    assert np.mean([r.near_edited for r in got]) > 0.25 > 0.1 > np.median([r.near_next for r in got])


@pytest.mark.parametrize("rows", [[], [(5, "solo " * 40)], [(1, None), (3, "b" * 5), (2, ""), (None, "ü€😀x"), (7, "long " * 30_000), (9, "end")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, place int, kind string")
    got = fp.compare_with_next(df).collect()
    assert len(got) == len(rows) and {r[0]: tuple(r[1:]) for r in got} == brute(rows)


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (1, "other")], "doc_id long, text string")
    got = fp.compare_with_next(df).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got}) == 2
