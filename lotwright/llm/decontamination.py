"""Benchmark decontamination by random-walk embeddings.

A benchmark item of m words leaks into a document where some run of the document's words is within (1 - similarity) * m
word edits of it. The walk of Chakraborty, Goldenberg and Koucky turns a word sequence into a longer one in which
few edits become few differing places. Sampling a few places of a walk gives a key; REPEATS walks give so many keys to
each item and each item-sized window that those near each other share one with the target recall. The items' keys are
buckets, in which the windows' keys are looked up: what shares a bucket is a candidate, and candidates are verified by
their exact edit distance.

Walking over every window of every length would cost thousands of steps a word, so windows are laid only where one can
match at all. Two conditions tell, which lose nothing and name no item: of the k + 1 equal parts of an item one is left
whole by k edits, so a window lies about a part of some item of its length; and it holds m - k words of the benchmark.

The benchmark is the query set. It goes to every task in blocks of at most BLOCK_WORDS words, so its size in memory is
bounded however long it is, and the documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Spans, mix

SIMILARITY = 0.8
#: Places sampled from a walk for one key, and keys for each window: over 0.99 of the windows at the limit share one.
SAMPLED, REPEATS = 2, 96
BLOCK_WORDS = 2_000_000
#: Windows walked over at once.
WINDOWS = 2000
_U = np.uint64
_PAD = _U(0xFFFFFFFFFFFFFFFF)


def normal_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and for each row the number before it."""
    data, offs = common.text_bytes(pc.utf8_lower(col))
    starts, ends, first = common.word_spans(data, offs)
    return common.word_hashes(data, starts, ends), first


def allowed(m: int, similarity: float) -> int:
    return int((1 - similarity) * m + 1e-9)


def keys(rows: np.ndarray, repeats: int = REPEATS, sampled: int = SAMPLED) -> np.ndarray:
    """(repeats, rows): a key from sampled places of each walk over equally long rows of words.

    At each of 3 * length steps each walk writes the word it stands at and goes on or stays, as a random function of walk,
    step and word says. The sampled places depend on the length alone, so items and windows agree.
    """
    n, m = rows.shape
    rnd = np.random.RandomState(m % 2**31)
    places = np.sort(np.stack([rnd.choice(3 * m, min(sampled, 3 * m), replace=False) for _ in range(repeats)]), axis=1)
    padded = np.concatenate([rows, np.full((n, 1), _PAD)], axis=1).ravel()
    base = np.arange(n) * (m + 1)
    seeds = mix(np.arange(1, repeats + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]
    out = mix(np.repeat(seeds, n, axis=1))
    # Walks by their last sampled place, so that those which are done drop out.
    order = np.argsort(-places[:, -1], kind="stable")
    at, last = np.zeros((repeats, n), np.int64), places[order, -1]
    for j in range(int(last[0]) + 1):
        live = order[: int(np.searchsorted(-last, -j, side="right"))]
        word = padded[base[None, :] + at[live]]
        now = (places[live] == j).any(axis=1)
        if now.any():
            out[live[now]] = mix(out[live[now]] * _U(31) + word[now])
        step = mix(word ^ (seeds[live] + _U(j * 0x632BE5AB & 0xFFFFFFFF))) >> _U(63)
        at[live] = np.minimum(at[live] + step.astype(np.int64), m)
    return out


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of the region's words nearest to the item by edits; the first of equal ones, and the longest."""
    n = len(region)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, word in enumerate(item.tolist(), 1):
        change = cost[:-1] + (region != _U(word))
        drop = cost[1:] + 1
        low, begin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        low[0], begin[0] = i, 0
        low[1:] = np.minimum(change, drop)
        begin[1:] = np.where(change <= drop, start[:-1], start[1:])
        # Words of the region that the item lacks: cost[j] = min over i <= j of low[i] + j - i.
        level = low - steps
        reach = np.minimum.accumulate(level)
        fresh = np.concatenate([[True], level[1:] < reach[:-1]])
        source = np.maximum.accumulate(np.where(fresh, steps, 0))
        # where the present place is as good, it stands by itself
        source = np.where(level == reach, steps, source)
        cost, start = reach + steps, begin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


_LOW = (1 << 20) - 1


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A map over the low bits of hashes: False only for those that are not among them."""
    out = np.zeros(_LOW + 1, bool)
    out[(hashes & _U(_LOW)).astype(np.int64)] = True
    return out


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return bits[(hashes & _U(_LOW)).astype(np.int64)]


@dataclass
class Index:
    """A block of items, made on the driver and sent to all tasks."""

    names: list[tuple]  # what names each item in the results
    items: list[np.ndarray]
    edits: list[int]
    #: By the parts' number of words: their sorted hashes, a map of them, and for each the items' length and the part's place.
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    vocabulary: np.ndarray
    #: By the items' length: the sorted keys of its buckets, and the item of each.
    buckets: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, rows: list[tuple[tuple, str]], similarity: float = SIMILARITY) -> Index:
        words, first = normal_words(pa.array([t for _, t in rows], pa.string()))
        at = [n for n in range(len(rows)) if first[n + 1] > first[n]]
        items = [words[first[n] : first[n + 1]] for n in at]
        edits = [allowed(len(x), similarity) for x in items]
        parts, by_length = defaultdict(set), defaultdict(list)
        for n, (item, k) in enumerate(zip(items, edits, strict=True)):
            m = len(item)
            by_length[m].append(n)
            starts = np.arange(k + 1) * m // (k + 1)
            size = m // (k + 1)
            parts[size].update(zip(Spans(item)(starts, starts + size).tolist(), [m] * (k + 1), starts.tolist(), strict=True))
        tables = {}
        for size, found in parts.items():
            h, m, place = (np.array(x, kind) for x, kind in zip(zip(*sorted(found), strict=True), (_U, np.int64, np.int64), strict=True))
            tables[size] = (h, _bits(h), m, place)
        buckets = {}
        for m, of in by_length.items():
            found = keys(np.stack([items[n] for n in of]))
            order = np.argsort(found.ravel(), kind="stable")
            buckets[m] = (found.ravel()[order], np.tile(np.array(of), len(found))[order])
        return cls([rows[n][0] for n in at], items, edits, tables, _bits(words), buckets)

    def windows(self, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: the row and the first word of each window that can match; it is cut off where the row ends."""
        spans, found = Spans(words), defaultdict(list)
        for size, (hashes, near, length, place) in self.parts.items():
            at = np.arange(max(0, len(words) - size + 1))
            grams = spans(at, at + size)
            at = np.flatnonzero(_in(near, grams))
            lo, hi = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], side="right")
            count = hi - lo
            part = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(at, count)
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + size <= first[row + 1]  # not over the end of a row
            for m in np.unique(length[part[inside]]).tolist():
                of = inside & (length[part] == m)
                found[m].append(np.stack([row[of], (at - place[part])[of]], axis=1))
        known = np.concatenate([[0], np.cumsum(_in(self.vocabulary, words))])
        out = {}
        for m, parts in found.items():
            row, start = np.unique(np.concatenate(parts), axis=0).T
            k = int(self.edits[self.buckets[m][1][0]])
            # The item's first word stands within k of where its part says, its last one too.
            lo, hi = np.maximum(first[row], start - k), np.minimum(first[row + 1], start + m + k)
            can = known[hi] - known[lo] >= m - k
            row, lo, hi = row[can], lo[can], hi[can]
            count = np.maximum(1, hi - lo - m + 1)
            begin = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out[m] = tuple(np.unique(np.stack([np.repeat(row, count), begin], axis=1), axis=0).T)
        return out

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first word of the window): the item and the window share a bucket."""
        for m, (row, begin) in self.windows(words, first).items():
            names, of = self.buckets[m]
            for a in range(0, len(row), WINDOWS):
                r, b = row[a : a + WINDOWS], begin[a : a + WINDOWS]
                place = b[:, None] + np.arange(m)
                inside = place < first[r + 1][:, None]
                found = keys(np.where(inside, words[np.minimum(place, len(words) - 1)], _PAD))
                nth = np.tile(np.arange(len(r)), len(found))
                flat = found.ravel()
                lo, hi = np.searchsorted(names, flat), np.searchsorted(names, flat, side="right")
                count = hi - lo
                item = of[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                nth = np.repeat(nth, count)
                for n, i in np.unique(np.stack([nth, item], axis=1), axis=0).tolist():
                    yield int(r[n]), i, int(b[n])

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word in the row, words, distance), the best of each row and item."""
        if not len(words) or not self.items:
            return []
        met = defaultdict(list)
        for row, i, begin in self.candidates(words, first):
            met[row, i].append(begin)
        out = []
        for (row, i), begins in sorted(met.items()):
            item, k, best = self.items[i], self.edits[i], None
            m = len(item)
            begins.sort()
            runs = np.split(np.array(begins), np.flatnonzero(np.diff(begins) > m) + 1)
            for run in runs:  # windows that overlap are verified as one
                lo, hi = max(int(first[row]), int(run[0]) - k), min(int(first[row + 1]), int(run[-1]) + m + k)
                region = words[lo:hi]
                if np.isin(item, region).sum() >= m - k:
                    distance, s, e = best_match(item, region)
                    if distance <= k and (best is None or distance < best[4]):
                        best = (row, i, lo + s - int(first[row]), e - s, distance)
            if best:
                out.append(best)
        return out


def _one_space(text: str) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.col(text).cast("string"), r"[\x09-\x0D\x20]+", " "))


def _blocks(benchmark: DataFrame, similarity: float) -> Iterator[Index]:
    """The benchmark's distinct items in blocks, each named by a 128-bit hash; null texts and those without a word are no items."""
    items = benchmark.select(_one_space("text").alias("text")).where("text <> ''").distinct()
    total = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n = -(-total // BLOCK_WORDS)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text").collect()
        yield Index.build(sorted(((r.a, r.b), r.text) for r in rows), similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, distance, similarity): where items stand in the documents' whole texts.

    One row for each row of docs and item, the best place; documents without items have none. Words are what white
    space (space, \\x09-\\x0D) leaves of the lower-cased text; distance counts words put in, left out or changed. Items
    of any length are looked for; of fewer than five words no edit is allowed, so one of a single common word is found
    wherever the word stands. Null and empty texts hold nothing; null doc_ids and item_ids are kept; equal rows give equal
    rows; items given twice count twice. Other columns are not read. Without documents or items there are no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())])
    types = "doc_id long, a long, b long, start_word long, n_words long, distance long, similarity double"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], types)
    for index in _blocks(benchmark, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in common.chunks(batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                out = [(ids[r], *index.names[i], s, n, d, 1 - d / len(index.items[i])) for r, i, s, n, d in index.matches(*normal_words(batch.column("text")))]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

        found = found.union(read.mapInArrow(rows, types))
    text = _one_space("text")
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    return found.join(named, ["a", "b"]).select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item; see find_leaks. Rows with null text stay."""
    for index in _blocks(benchmark, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.chunks(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in sent.value.matches(*normal_words(batch.column("text")))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, and which; clean documents have no row."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
