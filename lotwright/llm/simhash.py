"""SimHash near-duplicates, found by a byte-position inverted index with count filtering.

Fingerprints within max_bits differing bits share at least 8 - max_bits of their 8 bytes, place by place. Postings are
keyed by the bytes at four places, chosen so that any two fingerprints with six equal bytes meet in one posting; there
the equal bytes of each pair are tallied, pairs below the guaranteed minimum go, and the rest are compared bit by bit.
Postings longer than MAX_POSTING would give a number of pairs that grows with the square of a group of near copies.
Their fingerprints take an exact way whose rows grow in proportion: each is listed under itself and its 64 neighbours
of one bit, so that fingerprints within two bits, and no others, share an entry, which its smallest member represents.
Work is on distinct fingerprints; copies are only counted in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

MAX_POSTING = 32
#: Pairs of byte places; two of four pairs make a posting's key: whatever two places differ, one such key is equal.
_PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]

_LANES = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _LANES[_b] = [_b >> i & 1 for i in range(8)]
_LANES = _LANES.view(np.uint64).ravel()  # each bit of a byte in a byte of its own


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of counts[i] hashes: a bit is set if over half of the run's hashes have it."""
    ends = np.cumsum(counts)
    starts = ends - counts
    blocks = -(-counts // 255)  # 255 is the most that a lane of a byte can count
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    heads = starts[owner] + 255 * nth
    ones = np.zeros((len(counts), 64), np.int64)
    if len(heads):
        raw = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            part = np.add.reduceat(_LANES[raw[:, byte]], heads).view(np.uint8).reshape(-1, 8)
            np.add.at(ones[:, 8 * byte : 8 * byte + 8], owner, part)
    bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of all shingles of the lower-cased (A-Z) words; fewer words make one, none none."""
    w = text.lower().split()
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else []
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return [h(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the 64-bit SimHash of each whole text as a signed long; no words (or null): zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            raw, offs = common.text_bytes(batch.column("text"))
            raw = raw.tobytes()
            hashes = [shingle_hashes(raw[a:b], words) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            counts = np.array([len(x) for x in hashes], np.int64)
            flat = np.array([y for x in hashes for y in x], np.uint64)
            fp = majority_bits(flat, counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "id long, fp long")


def _byte(fp: Column | str, place: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * place).bitwiseAND(F.lit(255))


def _shared_bytes(a: Column, b: Column) -> Column:
    return sum((F.when(_byte(a.bitwiseXOR(b), i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Rows (a, b), a < b, over a table of distinct fingerprints (column fp) that connect all within max_bits bits.

    Every pair within max_bits is connected by rows, directly or through the representative of an entry both are in.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    keys = F.array(*[
        F.struct(F.lit(n).alias("place"), sum((_byte("fp", p) * (1 << 8 * i) for i, p in enumerate(x + y)), F.lit(0).cast("long")).alias("value"))
        for n, (x, y) in enumerate(combinations(_PAIRS, 2))
    ])
    postings = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.place", "k.value")
    sizes = postings.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = common.stage(postings.join(sizes, ["place", "value"]), "postings")
    short = sized.where(F.col("n") <= MAX_POSTING)
    pairs = short.select("place", "value", F.col("fp").alias("a")).join(short.select("place", "value", F.col("fp").alias("b")), ["place", "value"]).where("a < b")
    pairs = pairs.where(_shared_bytes(F.col("a"), F.col("b")) >= 8 - max_bits)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowded = sized.where(F.col("n") > MAX_POSTING).select("fp").distinct()
    if max_bits == 2:
        one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
        entries = crowded.select("fp", F.explode(one_bit).alias("entry"))
        least = entries.groupBy("entry").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # at most 65 by nature
        far = least.select("a", F.explode("all").alias("b")).where("a < b")
    else:
        near = [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)] if max_bits else []
        far = crowded.select("fp", F.explode(F.array(*near, F.col("fp"))).alias("b")).join(crowded.select(F.col("fp").alias("b")), "b", "left_semi").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).where("a < b")
    return pairs.union(far).distinct()


def near_duplicate_classes(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id) for every row of docs.

    Texts whose fingerprints differ in max_bits bits or fewer are linked; component_id is the smallest id that links
    lead to. Null and empty texts have fingerprint zero and link like others. A null id is kept and never is a
    component_id, unless no other is in its component. Equal rows stay apart; an empty table gives none; other columns
    are not read.
    """
    prints = common.stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = common.stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(links(least.select("fp"), max_bits))
    labelled = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only classes with links are gathered by root; the others are their own component.
    linked = labelled.join(roots.select(F.col("node").alias("fp")), "fp", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(linked, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(classes, "fp").select("id", "fp", "component_id")


SIMILARITY = 0.8
#: Shingles are ordered by how often their buckets occur, so that texts are indexed under what few others hold.
BUCKETS = 1 << 16


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with, for each text, the sorted hashes of its distinct shingles."""
    for batch in common.chunks(batches, "text"):
        raw, offs = common.text_bytes(batch.column("text"))
        raw = raw.tobytes()
        yield batch, [np.unique(np.array(shingle_hashes(raw[a:b], words), np.uint64)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 5)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _class_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["id", "t", "c", "fp", "counts"], np.zeros(BUCKETS, np.int32)
        for batch, sets in _sets(batches, words):
            flat = np.concatenate(sets)
            counts += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
            fp = majority_bits(flat, np.array([len(x) for x in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), _signed([_set_hash(x) for x in sets]), pa.array(fp.view(np.int64)), pa.nulls(batch.num_rows, pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([counts.tobytes()], pa.binary())], names)

    return rows


def _bucket_counts(prints: DataFrame) -> np.ndarray:
    """How often each bucket's shingles occur; added up in a few tasks, of which the driver gets one array each."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                counts += np.frombuffer(x, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    parts = prints.where("counts IS NOT NULL").select("counts").repartition(8).mapInArrow(total, "counts binary").collect()
    return sum((np.frombuffer(r.counts, np.int64) for r in parts), np.zeros(BUCKETS, np.int64))


def _prefix_rows(words: int, similarity: float, often: np.ndarray):
    """Rows (h, c, n, i): of each set c of n shingles those that a set of this similarity must share one of; i is their place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, words):
            sizes = [len(x) for x in sets]
            firsts = [n and n - int(np.ceil(similarity * n - 1e-9)) + 1 for n in sizes]
            heads = [x[np.lexsort((x, often[(x & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:k]] for x, k in zip(sets, firsts, strict=True)]
            h = np.concatenate([*heads, np.zeros(0, np.uint64)])
            c = np.repeat(np.array([_set_hash(x) for x in sets], np.uint64), firsts)
            i = np.concatenate([*[np.arange(k, dtype=np.int32) for k in firsts], np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), firsts)), pa.array(i)], ["h", "c", "n", "i"])

    return rows


def _jaccard_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text_a"):
            out, last, mine = [], None, None
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if a != last:
                    last, mine = a, set(shingle_hashes((a or "").encode(), words))
                other = set(shingle_hashes((b or "").encode(), words))
                out.append(len(mine & other) / max(1, len(mine | other)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return rows


#: Bits of a set's parity map: eight for each shingle, in powers of two, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: Members of a block of a crowded posting; a task meets two blocks at once.
BLOCK = 512


def parity_map(shingles: np.ndarray) -> bytes:
    """A bit for each of a power of two of buckets: whether the set has an odd number of shingles there.

    Maps of two sets differ in at most as many bits as there are shingles in one of them only. A map is folded to half
    its size by xor of its halves.
    """
    size = min(max(LEAST_BITS, 1 << (8 * len(shingles) - 1).bit_length() if len(shingles) else 0), MOST_BITS)
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _map_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([parity_map(x) for x in sets], pa.binary())], ["c", "bits"])

    return rows


def _differing_bits(maps: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the maps of rows x and y differ, the larger folded to the size of the smaller."""
    out, size = np.zeros(len(x), np.int64), np.array([len(m) for m in maps])
    place = np.zeros(len(maps), np.int64)
    tables = {}
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        place[own] = np.arange(len(own))
        tables[n, n] = np.frombuffer(b"".join([maps[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)

    def folded(n: int, to: int) -> np.ndarray:
        if (n, to) not in tables:
            wide = folded(n, 2 * to)
            half = wide.shape[1] // 2
            tables[n, to] = wide[:, :half] ^ wide[:, half:]
        return tables[n, to]

    kinds = size[x] << 32 | size[y]
    for kind in np.unique(kinds).tolist():
        at, (n, m) = np.flatnonzero(kinds == kind), (kind >> 32, kind & 0xFFFFFFFF)
        a, b = folded(n, min(n, m)), folded(m, min(n, m))
        step = max(1, (1 << 21) // a.shape[1])
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            out[part] = np.bitwise_count(a[place[x[part]]] ^ b[place[y[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _block_pairs(similarity: float):
    """Rows (a, b), a < b, of members of a posting that may be similar by their places, sizes and parity maps.

    Rows come sorted by (h, p, q), p and q being the blocks that meet; where they differ, only pairs across count.
    """
    share = similarity / (1 + similarity)

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, p, q, k, c, n, i, root = (t.column(name).to_numpy() for name in ("h", "p", "q", "k", "c", "n", "i", "root"))
        maps = t.column("bits").to_pylist()
        last = np.flatnonzero(np.append((h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), True)) + 1
        end = last[np.searchsorted(last, np.arange(len(h)), side="right")]
        partners = end - np.arange(len(h)) - 1
        total, lo = np.cumsum(partners), 0
        while lo < len(h):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 21), side="right")))
            many = partners[lo:hi]
            x = np.repeat(np.arange(lo, hi), many)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            fits = (root[x] != root[y]) & (c[x] != c[y]) & ((p[x] == q[x]) | (k[x] != k[y])) & (np.minimum(n[x] - i[x], n[y] - i[y]) >= (n[x] + n[y]) * share - 1e-6)
            x, y = x[fits], y[fits]
            near = _differing_bits(maps, x, y) <= (n[x] + n[y]) * (1 - 2 * share) + 1e-6
            found = np.unique(np.sort(np.stack([c[x[near]], c[y[near]]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            lo = hi

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            h, p, q = (t.column(name).to_numpy() for name in ("h", "p", "q"))
            same = (h == h[-1]) & (p == p[-1]) & (q == q[-1]) if t.num_rows else np.zeros(0, bool)
            cut = t.num_rows - int(same.sum())  # the last group may go on
            if cut:
                yield from pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return rows


def _may_reach(similarity: float) -> Column:
    """Of members x and y of a posting: what they can share from their places on is enough. True at the first shingle
    that two similar sets share, so no such pair is lost."""
    most = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    return most >= (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6


def _pairs(x: DataFrame, y: DataFrame, keys: list[str], similarity: float, more: Column | bool = True) -> DataFrame:
    """Rows (a, b), a < b, of members x and y that share keys and may be similar."""
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    met = x.alias("x").join(y.alias("y"), [*on, F.col("x.c") != F.col("y.c"), _may_reach(similarity), F.lit(True) if more is True else more])
    return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _print_pairs(classes: DataFrame) -> DataFrame:
    """Rows (a, b), a < b, of classes whose fingerprints are equal or linked, each fingerprint's least class standing for it."""
    least = common.stage(classes.groupBy("fp").agg(F.min("c").alias("first")), "prints")
    same = classes.join(least, "fp").where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    tied = links(least.select("fp")).withColumnRenamed("b", "fp").join(least.withColumnRenamed("first", "y"), "fp").drop("fp")
    tied = tied.withColumnRenamed("a", "fp").join(least, "fp").select(F.least("first", "y").alias("a"), F.greatest("first", "y").alias("b"))
    return same.union(tied)


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, t, component_id, root), t being xxhash64 of the text, for every row of docs: texts are linked whose shares of common shingles reach similarity.

    Texts of the same set of shingles are a class. Classes whose SimHash fingerprints are equal or share the guaranteed
    bytes of two bits are candidates, by the inverted index over byte positions. Two bits do not find all that are this
    similar, so an exact way finds the rest: each set is indexed under its rarest shingles, so many that a similar
    set must share one (prefix filtering); a pair that can still be similar by the places of a shared one is a candidate.
    All candidates are verified on the sets. In postings of more than MAX_POSTING members each is first held against two
    of them; then all that these links have not joined yet, by blocks, and what parity maps of the sets do not rule out
    is verified. So no similar pair stays apart, and nothing below similarity is linked.
    root names the component; component_id is its least id. Nulls, empty texts, repeated rows and empty tables are as
    in near_duplicate_classes.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    prints = common.stage(plain.mapInArrow(_class_rows(words), "id long, t long, c long, fp long, counts binary"), "sets")
    often = _bucket_counts(prints)
    prints = prints.where("counts IS NULL").select("id", "t", "c", "fp")
    classes = common.stage(prints.groupBy("c").agg(F.min("id").alias("least"), F.min("t").alias("t"), F.min("fp").alias("fp")), "classes")
    # Copies fall together where the rows of a posting are dealt.
    postings = plain.select("text").mapInArrow(_prefix_rows(words, similarity, often), "h long, c long, n int, i int").distinct()
    postings = common.stage(postings, "prefixes")
    sizes = common.stage(postings.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    sized = common.stage(postings.join(sizes, "h"), "postings")
    common.drop(postings, sizes)
    short = sized.where(F.col("size") <= MAX_POSTING)
    crowded = sized.where(F.col("size") > MAX_POSTING).withColumn("salt", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / MAX_POSTING)))
    member = F.min(F.struct("i", "c", "n")).alias("m")
    heads = crowded.groupBy("h").agg(member).select("h", "m.*")
    near_heads = crowded.groupBy("h", "salt").agg(member).select("h", "salt", "m.*")
    found = _pairs(short, short, ["h"], similarity, F.col("x.c") < F.col("y.c"))
    found = found.union(_pairs(crowded, heads, ["h"], similarity)).union(_pairs(crowded, near_heads, ["h", "salt"], similarity))
    found = found.union(_print_pairs(classes)).distinct()

    def texts_of(wanted: DataFrame) -> DataFrame:
        asked = wanted.distinct().join(classes.select("c", "t"), "c")
        return common.dealt_join(plain.select("id", "t", "text"), asked, "t", counted=prints, by=["id"]).groupBy("c").agg(F.min("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = common.stage(pairs, "pairs")
        texts = common.stage(texts_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b"))), "texts")
        both = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
        alike = both.select("a", "b", "text_a", "text_b").mapInArrow(_jaccard_rows(words), "a long, b long, similarity double")
        alike = common.stage(alike.where(F.col("similarity") >= similarity).select("a", "b"), "alike")
        common.drop(texts, pairs)
        return alike

    alike = verified(found)
    roots = connected_components(alike)
    open_ = crowded.join(roots.withColumnRenamed("node", "c"), "c", "left").select("h", "c", "n", "i", F.coalesce("root", "c").alias("root"))
    split = open_.groupBy("h").agg(F.count(F.lit(1)).alias("members"), (F.min("root") != F.max("root")).alias("apart")).where("apart").select("h", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    open_ = common.stage(open_.join(split, "h"), "open")
    maps = common.stage(texts_of(open_.select("c")).select("c", "text").mapInArrow(_map_rows(words), "c long, bits binary"), "maps")
    placed = open_.withColumn("k", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("p", F.least("k", "other")).withColumn("q", F.greatest("k", "other"))
    blocks = placed.join(maps, "c").select("h", "p", "q", "k", "c", "n", "i", "root", "bits")
    near = blocks.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(_block_pairs(similarity), "a long, b long")
    late = verified(near.distinct())
    common.drop(open_, maps)
    if late.take(1):
        roots = connected_components(alike.union(late))
    labelled = classes.select("c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    linked = labelled.join(roots.select(F.col("node").alias("c")), "c", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    final = labelled.join(linked, "root", "left").select("c", "root", F.coalesce("component_id", "least").alias("component_id"))
    return common.dealt_join(prints, final, "c", by=["id"]).select("id", "t", "component_id", "root")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
