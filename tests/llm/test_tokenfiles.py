import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotwright.llm import common, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    """doc_id, start, n_tokens and sum of rows (doc_id, text) without ties, by the tokenizer alone."""
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("lanes", "size", "vocabulary", "kind"), [(3, 40, 10, "any"), (5, 700, 49408, "mixed"), (1, 1, 5, "any"), (7, 300, 3, "any"), (2, 2000, 70000, "one"), (4, 900, 1 << 20, "new")])
def test_blocks_come_back(lanes, size, vocabulary, kind):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, vocabulary, (lanes, size))
    if kind == "mixed":
        ids[:, ::2] = rng.integers(0, 9, (lanes, (size + 1) // 2))
    elif kind == "one":
        ids[:] = vocabulary - 1
    elif kind == "new":
        ids[:] = np.arange(size) * 7 + vocabulary // 2
    blocks = tokenfiles.encode_blocks(ids, vocabulary)
    assert (tokenfiles.decode_blocks(blocks, size, vocabulary) == ids).all()
    if kind == "one":
        assert len(blocks[0]) < size / 20
    # Blocks are independent: one alone gives its ids and is the same bytes.
    assert (tokenfiles.decode_blocks(blocks[-1:], size, vocabulary) == ids[-1:]).all()
    assert tokenfiles.encode_blocks(ids[-1:], vocabulary) == blocks[-1:]


def test_tables_of_a_block_are_small():
    """The coder's time goes by what its tables take of the cache; they must hold the counts of long blocks too."""
    m = tokenfiles._Blocks(64, 2048, 49408)
    assert sum(x.nbytes for x in (m.slots, m.counts, m.weights)) < 64 * 12_000
    ids = np.full((1, 33_000), 7)
    ids[0, 32_900:] = np.arange(100)
    assert (tokenfiles.decode_blocks(tokenfiles.encode_blocks(ids, 100), 33_000, 100) == ids).all()


def test_coder_moves_weights_as_small_rows_and_keeps_its_format():
    """A confidence's four weights are one row of 16 bytes; the blocks are those of version 2, byte by byte."""
    m = tokenfiles._Blocks(8, 512, 49408)
    assert m.weights.nbytes == 8 * 32 * 16
    ids = np.random.default_rng(11).zipf(1.3, (16, 700)) % 49408
    ids[:, 300:400] = ids[:, :100]
    assert zlib.crc32(b"".join(tokenfiles.encode_blocks(ids, 49408))) == 1390029279
    assert zlib.crc32(b"".join(tokenfiles.encode_blocks(ids + 70_000, 1 << 17))) == 2093023424


def test_thousands_of_blocks_in_step_with_small_tables():
    """Python's cost of a step is shared by all blocks of a shard, so these are thousands, and each takes under 8,000 bytes."""
    size = tokenfiles.block_size(tokenfiles.SHARD_IDS)
    assert size == 2048 and tokenfiles.SHARD_IDS // size >= 4096
    m = tokenfiles._Blocks(64, size, 49408)
    assert sum(x.nbytes for x in (m.slots, m.counts, m.weights)) < 64 * 8_000


@pytest.mark.parametrize("size", [16_383, 16_384])
def test_blocks_at_the_bounds_of_the_tables_types(size):
    ids = np.arange(size)[None, :].repeat(2, axis=0)
    ids[0, 9000:] = ids[0, : size - 9000]
    assert (tokenfiles.decode_blocks(tokenfiles.encode_blocks(ids, 20_000), size, 20_000) == ids).all()


def test_places_by_frequency_are_found_without_search():
    """The decoder looks the rank at a place of the counts up in a table of all places."""
    ids = np.random.default_rng(2).zipf(1.5, (3, 100)) % 50
    m = tokenfiles._Blocks(3, 100, 50)
    m.names[:] = tokenfiles._names(ids)
    m.seen[:], m.at = m.names.max(axis=0), 100
    m._sum_up()
    assert m.total == 100
    for i in range(3):
        assert m.of_value[100 * i : 100 * (i + 1)].tolist() == sorted(m.names[:, i] - 1)


def test_repeats_cost_less():
    rng = np.random.default_rng(5)
    drawn = rng.integers(0, 5000, 64)
    again = np.tile(drawn, 64)[None, :]
    assert len(tokenfiles.encode_blocks(again, 49408)[0]) < 0.15 * len(tokenfiles.encode_blocks(rng.permutation(again[0])[None, :], 49408)[0])


def test_shard_is_read_in_part_and_damage_is_seen():
    rng = np.random.default_rng(9)
    counts = [1, 0, 3000, 1, 777]
    ids = rng.integers(0, 500, sum(counts))
    data = tokenfiles.write_shard([5, None, 7, 7, 9], counts, ids, 500)
    reader = tokenfiles.ShardReader(data)
    assert reader.doc_ids == [5, None, 7, 7, 9] and reader.ids().tolist() == ids.tolist()
    ends = np.cumsum(counts)
    for n, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
        assert reader.document(n).tolist() == ids[a:b].tolist()
    for at in random.Random(1).sample(range(len(data) - 2000, len(data) - 20), 20):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            tokenfiles.ShardReader(bytes(broken)).ids()
    with pytest.raises(ValueError):
        tokenfiles.write_shard([1], [1], np.array([500]), 500)


def test_long_document_by_parts(monkeypatch):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 5000)
    whole = tokenfiles.write_shard([1], [5000], ids, 300)
    monkeypatch.setattr(tokenfiles, "SHARD_IDS", 1200)
    assert tokenfiles.write_shard([1], [5000], ids, 300) == whole
    assert tokenfiles.ShardReader(whole).ids().tolist() == ids.tolist()


def test_driver_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = tokenfiles.op11_token_files(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == expected(docs)


def test_many_small_shards_and_ids(spark):
    rnd = random.Random(2)
    rows = [(i * 3, " ".join(rnd.choice(["alpha", "Beta", "it's", "日本", "x<|endoftext|>", "12,5"]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rnd.shuffle(rows)
    shards = common.stage(tokenfiles.write_token_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shard_ids=100), "shards")
    got = tokenfiles.read_token_shards(shards, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (1, None), (3, "word " * 300_000 + "é" * 40_000)], [(2, ""), (2, ""), (2, "x"), (2, "x")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, part int, id string")
    shards = common.stage(tokenfiles.write_token_shards(df, PATH), "shards")
    got = tokenfiles.read_token_shards(shards).collect()
    if len({r[0] for r in rows}) == len(rows):
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows)
    else:  # equal ids: by texts' hashes, gapless
        assert sorted((r.n_tokens for r in got)) == [1, 1, 2, 2]
        ordered = sorted(got, key=lambda r: r.start)
        assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()


def test_files(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    shards = tokenfiles.write_token_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shard_ids=30)
    tokenfiles.write_files(shards, str(tmp_path / "ids"))
    found = [d for f in sorted((tmp_path / "ids").iterdir()) for d in tokenfiles.ShardReader(f.read_bytes()).doc_ids]
    assert found == list(range(50))


def test_files_of_both_versions_are_read(monkeypatch):
    """Files are written in version 3, which sums frequencies up when the ids seen have doubled and learns weights at every fourth; those of version 2 are read as before."""
    ids = np.random.default_rng(8).zipf(1.3, 5000) % 900
    new = tokenfiles.write_shard([1], [5000], ids, 900)
    monkeypatch.setattr(tokenfiles, "_VERSION", 2)
    old = tokenfiles.write_shard([1], [5000], ids, 900)
    assert (new[8], old[8]) == (3, 2) and len(new) < 1.1 * len(old)
    assert tokenfiles.ShardReader(new).ids().tolist() == tokenfiles.ShardReader(old).ids().tolist() == ids.tolist()
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(new[:8] + b"\4" + new[9:])


@pytest.mark.parametrize(("lanes", "size", "vocabulary", "kind"), [(3, 40, 10, "any"), (5, 700, 49408, "any"), (1, 1, 5, "any"), (2, 2000, 70000, "one"), (4, 900, 1 << 20, "new"), (2, 17_000, 60_000, "new")])
def test_blocks_of_version_3_come_back(lanes, size, vocabulary, kind):
    ids = np.random.default_rng(6).integers(0, vocabulary, (lanes, size))
    if kind == "one":
        ids[:] = vocabulary - 1
    elif kind == "new":
        ids[:] = np.arange(size) * 3 + 1
    blocks = tokenfiles.encode_blocks(ids, vocabulary, 3)
    assert (tokenfiles.decode_blocks(blocks, size, vocabulary, 3) == ids).all()
    assert tokenfiles.encode_blocks(ids[-1:], vocabulary, 3) == blocks[-1:]


def test_version_3_sums_up_seldom(monkeypatch):
    calls, weighed, sum_up, weigh = [], [], tokenfiles._Blocks._sum_up, tokenfiles._Blocks._weigh
    monkeypatch.setattr(tokenfiles._Blocks, "_sum_up", lambda m: (calls.append(m.at), sum_up(m)))
    monkeypatch.setattr(tokenfiles._Blocks, "_weigh", lambda m: (weighed.append(m.at), weigh(m)))
    tokenfiles.write_shard([1], [512], np.arange(512) % 40, 50)
    assert calls == [0, 16, 32, 64, 128, 256] and weighed == list(range(0, 512, 4))


def test_ranks_by_a_table_are_those_by_sorting():
    ids = np.random.default_rng(12).zipf(1.2, (tokenfiles._LOOKED_UP, 500)) % (1 << 16)
    assert (tokenfiles._looked_up_ranks(ids.astype(np.uint32)) == tokenfiles._ranks(ids)).all()
