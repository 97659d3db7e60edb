import random

import numpy as np
import pytest
import xxhash

from lotwright.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()]
    n = max(1, len(words) - 2) if words else 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in simhash.op7_simhash_near_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    rows.sort(key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps)
    for r, fp, c in zip(rows, fps, comp, strict=True):
        assert got[r.doc_id].fingerprint == f"{fp:016x}"
        assert got[r.doc_id].component_id == rows[c].doc_id


def test_crowded_postings_lose_no_link(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(120):
            x = b
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(df).collect()
    back = {x: i for i, x in enumerate(signed)}
    from itertools import combinations

    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = find(back[r.a]), find(back[r.b])
        root[max(a, b)] = min(a, b)
    want = brute_components(fps)
    assert [find(i) for i in range(len(fps))] == want
    assert all(bin(fps[back[r.a]] ^ fps[back[r.b]]).count("1") <= 2 for r in links)
    assert len(links) < len(list(combinations(range(120), 2))) * 6


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A B"), (4, "A B"), (5, "x " * 3000)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fp string, n int")
    got = sorted((r.id is None, r.id or 0, r.fp, r.component_id) for r in simhash.near_duplicate_classes(df).collect())
    assert len(got) == len(rows)
    if rows:
        assert [g[3] for g in got if g[1] in (1, 2, 3)] == [1, 1, 1]
        assert [g[3] for g in got if g[1] == 4] == [4, 4] and [g[3] for g in got if g[0]] == [4]


def test_majority_over_many_shingles():
    h = np.random.RandomState(1).randint(0, 2**63, 2000).astype(np.uint64)
    counts = np.array([0, 1, 700, 0, 1299])
    want, at = [], 0
    for c in counts:
        part = h[at : at + c].tolist()
        at += c
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > c))
    assert simhash.majority_bits(h, counts).tolist() == want


def similar(texts, least=0.8):
    """Components of texts that share so much of their five-word shingles."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_similar_classes_against_brute_force(spark):
    rnd = random.Random(9)
    texts = []
    for g in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 300))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, len(base) // 60, len(base) // 10])):
                copy[rnd.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "a b", "A  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.similar_classes(df).collect()}
    want = similar(texts)
    assert len(got) == len(texts)
    joined = {(i, want[i]) for i in range(len(texts)) if want[i] != i}
    assert all(want[c] == want[i] for i, c in got.items())  # nothing is joined that is not alike
    assert sum(got[i] == got[c] for i, c in joined) >= 0.9 * len(joined) and len(joined) > 40
    assert simhash.similar_classes(df.limit(0)).collect() == []


def found_of(spark, texts):
    got = simhash.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.component_id for r in sorted(got, key=lambda r: r.id)]


def test_no_link_is_lost_in_a_large_group(spark):
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for g in range(600):  # alike, mostly below 0.8; some have a copy of their own just above it
        x = list(base)
        for _ in range(rnd.randint(3, 9)):
            x[rnd.randrange(200)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(x))
        if g % 10 == 0:
            for _ in range(3):
                x[rnd.randrange(200)] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(x))
    want = similar(texts)
    assert len({c for c in want}) > 100 and sum(want[c] != i for i, c in enumerate(want)) > 60
    assert found_of(spark, texts) == want


def test_repeated_lines_join_no_unlike_texts(spark):
    line = " ".join(f"line{i}" for i in range(11))
    texts = [" ".join([line] * 30 + [f"{x}{i}" for i in range(100)]) for x in "abcd"]
    fps = [simhash.majority_bits(np.array(h, np.uint64), np.array([len(h)]))[0] for h in (simhash.shingle_hashes(t.encode(), 5) for t in texts)]
    assert all(bin(fps[0] ^ f).count("1") <= 2 for f in fps)
    assert found_of(spark, texts) == [0, 1, 2, 3]


def test_copies_with_repeated_lines_are_found(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(20):
        body, line = (" ".join(f"w{rnd.randrange(10**5)}" for _ in range(n)) for n in (300, 11))
        texts += [f"{body} {' '.join([line] * n)}" for n in (1, 2, 20, 30)]
    want = [i - i % 4 for i in range(80)]
    assert similar(texts) == want
    assert found_of(spark, texts) == want


def alike_below(n, seed=5):
    """Texts that share some 0.65 to 0.78 of their shingles with each other."""
    rnd, base, texts = random.Random(seed), [f"b{i}" for i in range(200)], []
    for _ in range(n):
        x = list(base)
        for at in rnd.sample(range(200), 5):
            x[at] = f"e{rnd.randrange(10**9)}"
        texts.append(" ".join(x))
    return texts


def test_few_pairs_are_staged_in_a_large_group_below_the_threshold(spark, monkeypatch):
    staged, stage = {}, simhash.common.stage

    def counted(df, name, *a):
        out = stage(df, name, *a)
        staged.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash.common, "stage", counted)
    rows = []
    for n in (150, 600):
        staged.clear()
        texts = alike_below(n)
        assert found_of(spark, texts) == similar(texts)
        rows.append(staged["pairs"])
    assert rows[1][0] < 12 * n  # with the heads of postings: in proportion
    assert rows[1][1] < n  # the late step: what parity maps leave


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (40, 44), (130, 100), (700, 900), (20_000, 19_000), (1000, 9)):
        shared = rng.integers(0, 2**63, min(n, m) // 2, np.int64).astype(np.uint64)
        a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, n - len(shared)).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, m - len(shared)).astype(np.uint64)]))
        maps = [simhash.parity_map(a), simhash.parity_map(b), simhash.parity_map(a)]
        got = simhash._differing_bits(maps, np.array([0, 0, 1]), np.array([1, 2, 0]))
        differ = len(np.setxor1d(a, b))
        assert got[1] == 0 and got[0] == got[2] <= differ and got[0] % 2 == differ % 2
        assert got[0] > 0.6 * differ or max(n, m) > 5000 or min(n, m) < 10


def test_blocks_meet_once_each():
    import pyarrow as pa

    words = 5
    texts = alike_below(40) + ["w " * 3]
    sets = [np.unique(np.array(simhash.shingle_hashes(t.encode(), words), np.uint64)) for t in texts]
    rows = []
    for c, x in enumerate(sets):
        k = c % 3
        for other in range(3):
            rows.append((7, min(k, other), max(k, other), k, c, len(x), 0, c // 2, simhash.parity_map(x)))
    rows.sort(key=lambda r: r[:3])
    names = ["h", "p", "q", "k", "c", "n", "i", "root", "bits"]
    for sizes in ((len(rows),), (1,) * len(rows), (50, len(rows) - 50)):
        batches, at = [], 0
        for n in sizes:
            batches.append(pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + n], strict=True)], names))
            at += n
        got = [(r["a"], r["b"]) for b in simhash._block_pairs(0.6)(iter(batches)) for r in b.to_pylist()]
        want = [(i, j) for i in range(41) for j in range(i + 1, 41) if i // 2 != j // 2 and len(sets[i]) and len(np.setxor1d(sets[i], sets[j])) <= (len(sets[i]) + len(sets[j])) / 4]
        assert set(want) <= set(got) and len(got) == len(set(got)) and len(got) < 1.2 * len(want) + 5
