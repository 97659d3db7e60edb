import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lotwright.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_sides():
    """Ids and byte tables of both sides, without the module."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in kept}
    for n, x in enumerate(x for x in range(256) if x not in kept):
        chars[chr(256 + n)] = x
    vocabulary = json.load(open(PATHS[0]))["model"]["vocab"]
    a_bytes = {i: bytes(chars[c] for c in p) if all(c in chars for c in p) else p.encode() for p, i in vocabulary.items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def of(text):
        raw = b" " + text.encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not text or b"".join(a_bytes[i] for i in x) != raw or b"".join(map(piece, y)) != raw:
            return [], [], [], []
        return x, y, [len(a_bytes[i]) for i in x], [len(piece(i)) for i in y]

    return of


def expected(docs, sides):
    """Rows by brute force: groups between common ends, all links written out, counts in one dictionary."""
    grouped, counts = [], Counter()
    for _, text in docs:
        a, b, len_a, len_b = sides(text or "")
        ends_a, ends_b = np.cumsum(len_a).tolist(), np.cumsum(len_b).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1 if end in ends_a else i, ends_b.index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        grouped.append((a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for (doc_id, _), (a, b, groups, links) in zip(docs, grouped, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_components_are_those_of_a_search():
    rnd = random.Random(4)
    for _ in range(50):
        n = rnd.randint(1, 60)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 70))]
        edges += [(i, i + 1) for i in range(n - 1) if rnd.random() < 0.7]
        got = align.components(n, np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
        near = defaultdict(set)
        for x, y in edges:
            near[x].add(y)
            near[y].add(x)
        for start in range(n):
            seen, open_ = {start}, [start]
            while open_:
                for y in near[open_.pop()] - seen:
                    seen.add(y)
                    open_.append(y)
            assert got[start] == min(seen)


def test_long_chain_is_one_component():
    n = 200_000
    order = np.random.default_rng(1).permutation(n)
    assert (align.components(n, order[:-1], order[1:]) == 0).all()


def test_driver_table(spark, sf, plain_sides):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert by_text(align.op12_cross_tokenizer_alignment(spark, sf).collect()) == by_text(expected(docs, plain_sides))


ODD = [
    (1, None), (2, ""), (3, " "), (None, "a  b\n\n\tc   d"), (4, "日本語テキスト🙂🙂 naïve <|endoftext|> <s> </s> <0x41>"), (4, "日本語テキスト🙂🙂 naïve <|endoftext|> <s> </s> <0x41>"),
    (5, "▁ has the mark ▁"), (6, "x\x00y\x7f"), (7, "́́ é"), (8, "https://x.example/a?b=c&d=%20%20%20"), (9, "aaaa" * 50), (10, "ab" * 3 + "   " * 9 + "."),
]


def test_odd_rows(spark, plain_sides):
    df = spark.createDataFrame([(*r, 5, "k") for r in ODD], "doc_id long, text string, segment int, pair string")
    got = align.alignment(df, *PATHS).collect()
    assert by_text(got) == by_text(expected(ODD, plain_sides))


def test_empty_table(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_small_segments(spark, plain_sides):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["thonre", "Enti", "naïve", "日本", "ofti🙂", "x" * 9]) for _ in range(rnd.randint(0, 20)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert by_text(align.alignment(df, *PATHS, segment_bytes=1).collect()) == by_text(expected(docs, plain_sides))


def test_large_groups_by_distinct_ids(monkeypatch):
    own, text = align.Tokenizers(*PATHS), "日本語テキスト🙂🙂 naïve " * 20 + "x" * 300 + "́" * 40
    plain = [x.tolist() for x in align.Groups(own, *own.ids([text, "a", text])).pairs()]
    monkeypatch.setattr(align, "LAID_OUT", 2)
    g = align.Groups(own, *own.ids([text, "a", text]))
    assert (g.in_a * g.in_b > 2).any()
    assert [x.tolist() for x in g.pairs()] == plain
    assert sum(plain[2]) == g.n_links.sum()


def test_words_by_themselves_give_the_texts_ids(plain_sides, monkeypatch):
    monkeypatch.setattr(align, "KEPT_WORDS", 20)
    own, rnd = align.Tokenizers(*PATHS), random.Random(6)
    parts = ["a", "bc", " ", " ", " ", "  ", "\n", "1", ".", "é", "日", "'s", "<s>", "word", "▁", "\x1c", "\x85", "\u00a0", "\u3000", "!!", "The"]
    texts = ["".join(rnd.choice(parts) for _ in range(120)) for _ in range(300)] + ["x" * 5000 + " y", " lead", "trail ", ""]
    for text, a, b in zip(texts, *own.ids(texts), strict=True):
        assert (a.tolist(), b.tolist()) == tuple(plain_sides(text)[:2]), text


def test_pairs_are_counted_by_one_sort():
    rng = np.random.default_rng(7)
    docs, a, b = np.sort(rng.integers(0, 40, 5000)), rng.integers(0, 9, 5000), rng.integers(0, 7, 5000)
    plain = [x.tolist() for x in align._added_up(docs, a << 32 | b, np.ones(5000, np.int64))]
    assert [x.tolist() for x in align._counted(docs, a, b)] == plain
    huge = [x.tolist() for x in align._counted(docs, a << 27, b << 28)]  # more than one number holds
    assert huge[0] == plain[0] and huge[2] == plain[2]
    assert [len(x) for x in align._counted(docs[:0], a[:0], b[:0])] == [0, 0, 0]


def test_words_are_compared_at_once():
    """Unfit words among others are told from them, also where the sizes agree; the words' ids are those of each by itself."""
    own = align.Tokenizers(*PATHS)
    words = ["thonre", "▁", "Enti", "naïve▁", "x\x00y", "日本語🙂", "́́", "a\n\nb", "it's"]
    at_once, alone = own._of_words(words), [own._of_words([w])[0] for w in words]
    assert at_once == alone and alone[1] is False and alone[3] is False
    for w, ids in zip(words, at_once, strict=True):
        raw = b" " + w.encode()
        if ids:
            assert all(b"".join(table[i] for i in np.frombuffer(x, "<u4")) == raw for x, table in zip(ids, (own.bytes_a, own.bytes_b), strict=True))
    own.bytes_b = [x[::-1] for x in own.bytes_b]  # sizes agree, bytes do not
    assert own._of_words(["thonre", "Enti"]) == [False, False]


def test_cuts_are_lone_spaces():
    rnd = random.Random(5)
    parts = ["a", " ", " ", "\n", "é", "日", "あ", "\x1c", "\x85", "\u00a0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "…"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.append(0, np.cumsum([len(x.encode()) for x in texts]))
    at = set(align._cuts(data, offs).tolist())
    lone = {o + len(x[: m.start()].encode()) for o, x in zip(offs.tolist(), texts, strict=False) for m in align._CUT.finditer(x)}
    plain = {o + len(x[: m.start()].encode()) for o, x in zip(offs.tolist(), texts, strict=False) for m in align._CUT.finditer(x) if x[m.start() - 1] in "aé日" and x[m.end()] in "aé日"}
    assert plain and plain <= at <= lone


def test_words_are_encoded_together():
    own, calls = align.Tokenizers(*PATHS), []
    plain = own.b.encode
    own.b = type("B", (), {"encode": lambda self, texts, **k: calls.append(len(texts)) or plain(texts, **k)})()
    words = [f"word{i}" for i in range(500)]
    assert own._of_words(words) == align.Tokenizers(*PATHS)._of_words(words) and sum(calls) < 20


def test_group_rows_and_counts(spark):
    docs = spark.createDataFrame([(1, "thonre Enti"), (2, "Enti"), (3, None)], "doc_id long, text string")
    groups = align.aligned_groups(docs, *PATHS).orderBy("doc_id", "nth").collect()
    own = align.Tokenizers(*PATHS)
    for doc_id, text in ((1, "thonre Enti"), (2, "Enti")):
        mine = [g for g in groups if g.doc_id == doc_id]
        assert b"".join(own.bytes_a[i] for g in mine for i in g.a_ids) == b"".join(own.bytes_b[i] for g in mine for i in g.b_ids) == b" " + text.encode()
        assert [g.nth for g in mine] == list(range(len(mine)))
    counts = align.pair_counts(align.staged_segments(docs, *PATHS)).select(align.a_of("pair").alias("a"), align.b_of("pair").alias("b"), "docs").collect()
    last = [g for g in groups if g.doc_id == 2]
    for g in last:
        for a in g.a_ids:
            for b in g.b_ids:
                assert next(r.docs for r in counts if (r.a, r.b) == (a, b)) == 2


def test_long_texts_go_by_runs(monkeypatch):
    rnd = random.Random(2)
    own, words = align.Tokenizers(*PATHS), ["thonre", "Enti", "naïve", "日本", "  ", "\n", "ofti🙂", "x" * 40]
    for bad in ("", " ▁ "):
        text = " ".join(rnd.choice(words) for _ in range(300)) + bad + "the end"
        g = align.Groups(own, *own.ids([text]))
        _, pairs, times = g.pairs()
        said = g.texts(own)[0]
        monkeypatch.setattr(align, "RUN_CHARS", 50)
        assert len(list(align._runs(text))) > 10 and " ".join(align._runs(text)) == text
        counts, sha, keys, n = align._long_document(own, text)
        assert counts == [int(x[0]) for x in (g.n_a, g.n_b, g.n_groups, g.n_links)] and (counts[0] == 0) == bool(bad)
        assert sha == (hashlib.sha256(said.encode()).hexdigest() if said else "") and keys.tolist() == pairs.tolist() and n.tolist() == times.tolist()


def test_a_text_of_several_runs(spark):
    text = "thonre Enti naïve 日本 " * 200_000
    short = text[: len("thonre Enti naïve 日本 ") * 3]
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    got = {r.doc_id: r for r in align.alignment(docs, *PATHS).collect()}
    a_each = (got[2].n_a - 1) / 3
    assert abs(got[1].n_a - a_each * 200_000) <= 2 and got[1].n_links > 60_000 * got[2].n_links and got[1].groups_sha256
    assert align.aligned_groups(docs, *PATHS).where("doc_id = 1").count() == got[1].n_groups
