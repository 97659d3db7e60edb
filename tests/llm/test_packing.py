import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lotwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_bfd(lengths, top):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(top - n)
    return sorted(room)


def filled(rows, top):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    left = []
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        left.append(top - at)
    return sorted(left)


def test_same_packing_as_piece_by_piece(spark):
    rnd = random.Random(6)
    for top in (10, 64):
        lengths = [rnd.choice([top, rnd.randint(1, top), rnd.randint(1, 4)]) for _ in range(700)]
        df = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
        rows = packing.pack(df, top).collect()
        assert Counter(r.length for r in rows) == Counter(lengths)
        assert filled(rows, top) == brute_bfd(lengths, top)


def test_tree_finds_the_tightest():
    rnd, tree, have = random.Random(1), packing.CapacityTree(100), Counter()
    for _ in range(3000):
        c = rnd.randint(0, 100)
        if have[c] and rnd.random() < 0.6:
            have[c] -= 1
            tree.add(c, -1)
        else:
            have[c] += 1
            tree.add(c, 1)
        q = rnd.randint(0, 100)
        assert tree.tightest(q) == min((x for x in have if have[x] and x >= q), default=None)


def test_ids_equal_the_tokenizers_own():
    encode, tok = packing._encoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    odd = ["Straße ΣΑΣ x́ <|endoftext|> it's we'LL!! a​b 日本 \x1c x\x85y ¼²x İx ǄS ﬁ Ⅷ \x00  z", "", " \n\t", "I'M they'RE a­b 12,5€ <|startoftext|>x"]
    odd += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x300, 0x3000)])) for _ in range(200)) for _ in range(50)]
    for text in odd:
        assert encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_batches_of_texts_equal_the_tokenizers_own(monkeypatch):
    encode, tok = packing._encoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(8)
    signs = ["it's", "D'un", "L'Été", "x''s", "--'ll", "'", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "12²3½", "\u00a0", "a\x00b", "ȺȾ", "ab\u0301", "日本語", "ΣΑΣ", " ", "\t\n", "A1b2", "word.", "Ünï-cÖde"]
    texts = ["".join(rnd.choice(signs) + rnd.choice(["", " "]) for _ in range(rnd.randrange(30))) for _ in range(300)]
    texts += [f"a{chr(c)}B {chr(c)}{chr(c)}1 '{chr(c)}" for c in range(0x400)] + ["", None, "'", "<", "é", "²"]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1 << 22, 50, 1):
        monkeypatch.setattr(packing, "ENCODED_BYTES", size)
        ids, counts = encode.rows(pa.array(texts))
        assert counts.tolist() == [len(x) for x in want]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert encode.rows(pa.array(["a", "b c", "d"]).slice(1, 1))[1].tolist() == [2]
    assert [len(x) for x in encode.rows(pa.array([], pa.string()))] == [0, 0]


def test_new_words_of_known_parts_cost_little():
    """Words that differ in case and signs alone are no work for Python one by one."""
    encode, rnd = packing._encoder(PATH), random.Random(4)
    stems = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    words = [f"{rnd.choice(stems).title()}{a}{b},{rnd.choice(stems)}" for a in range(100) for b in range(1000)]
    text = " ".join(words).encode()
    encode(" ".join(stems).encode())
    began = time.process_time()
    ids = encode(text)
    took, began = time.process_time() - began, time.process_time()
    slowest = {w: w.lower().title() for w in text.decode().split()}
    assert len(ids) > 3 * len(slowest) == 300_000
    assert took < 5 * (time.process_time() - began)


def test_driver_table(spark, sf):
    tok = Tokenizer.from_file(PATH)
    docs = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op1_best_fit_packing(spark, sf).collect()
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.length == 4096 or r.start + r.length == len(docs[r.doc_id])
    assert filled(rows, 4096) == brute_bfd([r.length for r in rows], 4096)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "word " * 30_000)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, sequence_id int")
    got = packing.pack_documents(df, PATH, with_ids=True).collect()
    assert sum(r.length for r in got) == (30_001 + 1 + 1 + 1 + 3 if rows else 0)
    assert all(len(r.ids) == r.length for r in got)
    filled(got, 4096)


def test_kept_parts_are_tokenized_once_and_stay_few(monkeypatch):
    """Parts' ids are kept by number over many batches; a full table begins anew, and the ids stay those of the tokenizer."""
    encode, tok = packing._Encoder(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "KEPT_PARTS", 60)
    rnd = random.Random(7)
    for n in range(12):
        texts = [" ".join(rnd.choice(["aa", "Bé", "it's", "x1"]) + str(rnd.choice(["", "lon", "ti", n]) * rnd.randint(1, 6)) for _ in range(20)) for _ in range(4)] + ["", " \t\n"]
        ids, counts = encode.rows(pa.array(texts))
        want = [tok.encode(x, add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))
        assert len(encode.known) == len(encode.places) == len(encode.sizes) <= 120 and encode.sizes.sum() == len(encode.ids)
        known = dict(encode.known)
        encode.rows(pa.array(texts))
        assert encode.known == known
    encode.rows(pa.array([" \n "]))
