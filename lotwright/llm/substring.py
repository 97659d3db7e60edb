"""Removal of long repeated word sequences, found by recompression.

Rounds replace runs of one symbol, then pairs of a left-class and a right-class symbol, by new symbols. Whether two
neighbours are joined depends on these two alone, so equal substrings get equal interior symbols wherever they stand:
each half round makes at most one more symbol at either end depend on what is outside. Names are hashes of what they
stand for, so all tasks agree on them without a dictionary that would have to be shuffled. In each window the interior of
the highest round in which it is not empty is looked at; its least symbol, with the words beside it that surely are in
the window, is the window's anchor. Equal windows have equal anchors, and one anchor serves many windows. A Spark round
counts the anchors over all documents: only windows whose anchor repeats can repeat. A second round counts these whole
windows by two hashes of 62 bits, each from word hashes of its own at bases of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Spans, mix

WINDOW = 35
ROUNDS = 3
#: Texts of more bytes are worked through by slices of so many, so that memory grows little with them.
SLICE_BYTES = 1 << 20
_U = np.uint64


def half_rounds(symbols: np.ndarray, heads: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each half round (runs, then pairs): the first word of each symbol, and the symbols.

    heads: whether a word is the first of its document; documents are never joined.
    """
    begins = np.arange(len(symbols))
    for k in range(rounds):
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != symbols[:-1]) | heads[1:]
        at = np.flatnonzero(keep)
        times = np.diff(np.append(at, len(symbols))).astype(_U)
        symbols, heads, begins = symbols[at], heads[at], begins[at]
        symbols = np.where(times > 1, mix(symbols * _U(3) + times), symbols)
        yield begins, symbols
        right = (mix(symbols + _U(k + 1)) >> _U(40) & _U(1)).astype(bool)
        keep = np.ones(len(symbols), bool)
        keep[1:] = ~right[1:] | right[:-1] | heads[1:]
        at = np.flatnonzero(keep)
        double = np.diff(np.append(at, len(symbols))) == 2
        after = symbols[np.minimum(at + 1, len(symbols) - 1)]
        symbols, heads, begins = np.where(double, mix(symbols[at] * _U(5) + mix(after)), symbols[at]), heads[at], begins[at]
        yield begins, symbols


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the first least value in each values[lo:hi], hi > lo."""
    width, out = hi - lo, np.empty(len(lo), np.int64)
    best, step, k = np.arange(len(values)), 1, 0
    while len(lo):
        of = (width >> k) == 1  # 2**k <= width < 2**(k + 1)
        a, b = best[lo[of]], best[hi[of] - step]
        out[of] = np.where(values[b] < values[a], b, a)
        if not (width >> (k + 1)).any():
            return out
        a, b = best[:-step], best[step:]
        best = np.concatenate([np.where(values[b] < values[a], b, a), best[len(best) - step :]])
        step, k = 2 * step, k + 1
    return out


def _break(data: np.ndarray, at: int) -> int:
    """The first white space at this byte or after it, else the end."""
    for i in range(at, len(data), 1 << 16):
        found = np.flatnonzero(common.is_space(data[i : i + (1 << 16)]))
        if len(found):
            return i + int(found[0])
    return len(data)


def _words_in(data: np.ndarray) -> int:
    solid = ~common.is_space(data)
    return int(solid[:1].sum()) + int((solid[1:] & ~solid[:-1]).sum())


def slices(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """A text cut at white space into bytes [a, b) of some SLICE_BYTES, and the number of words there."""
    a = 0
    while a < len(data):
        b = _break(data, a + SLICE_BYTES)
        yield a, b, _words_in(data[a:b])
        a = b


class Parsed:
    """The words of a batch of texts, its windows and their anchors."""

    def __init__(self, col: pa.Array | np.ndarray, window: int = WINDOW):
        """col: texts, or the bytes of one."""
        self.data, offs = (col, np.array([0, len(col)])) if isinstance(col, np.ndarray) else common.text_bytes(col)
        self.starts, self.ends, self.first = common.word_spans(self.data, offs)
        self.n_words = np.diff(self.first)
        self.window = window
        per = np.maximum(0, self.n_words - window + 1)
        #: Windows: first word and row.
        self.row = np.repeat(np.arange(len(per)), per)
        self.begin = np.arange(len(self.row)) - np.repeat(np.cumsum(per) - per, per) + self.first[:-1][self.row]
        self.words = self._hashes(2)
        self.spans = Spans(self.words)

    def _hashes(self, seed: int) -> np.ndarray:
        """Hashes of all words, made of a bounded run of bytes at once; a longer word is a run of its own."""
        out, a = np.zeros(len(self.starts), _U), 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + common.CHUNK_BYTES, side="right")))
            at = self.starts[a]
            out[a:b] = common.word_hashes(self.data[at : self.ends[b - 1]], self.starts[a:b] - at, self.ends[a:b] - at, seed)
            a = b
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the place of its anchor, and the anchor's name."""
        n, begin, end = len(self.words), self.begin, self.begin + self.window
        place, name = np.full(len(begin), -1, np.int64), np.zeros(len(begin), _U)
        if not len(begin):
            return place, name
        heads = np.zeros(n, bool)
        heads[self.first[:-1][self.n_words > 0]] = True
        lo, hi, found = begin, end, []
        for margin, (begins, symbols) in enumerate(half_rounds(self.words, heads), 1):
            # The first boundary after lo and the last before hi; where none is left, lo >= hi from now on.
            edges = np.append(begins, n)
            mark = np.zeros(n + 2, np.int64)
            mark[edges] = 1
            upto = np.cumsum(mark)  # boundaries at or before a word
            a, b = upto[lo], upto[hi - 1] - 1
            empty = (a > b) | (lo >= hi)
            lo, hi = edges[np.minimum(a, len(edges) - 1)], edges[np.maximum(b, 0)]
            lo = np.where(empty, n, lo)
            hi = np.where(empty, 1, hi)
            if margin % 2 == 0:
                found.append((margin, edges, symbols, np.where(empty, 0, a), np.where(empty, 0, b)))
        left = np.ones(len(begin), bool)
        for margin, edges, symbols, a, b in reversed(found):
            at = np.flatnonzero(left & (b > a))
            best = _least(mix(symbols + _U(7)), a[at], b[at])
            place[at] = edges[best]
            # margin words on either side are surely in the window: each half round has lost one at least
            name[at] = self.spans(edges[best] - margin, edges[best + 1] + margin) ^ _U(margin)
            left[at] = False
        at = np.flatnonzero(left)  # so repetitive that no symbol lies inside: the window is its own anchor
        place[at], name[at] = begin[at], self.spans(begin[at], end[at])
        return place, name

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of whole windows."""
        second = Spans(self._hashes(5), 4)
        return self.spans(self.begin[at], self.begin[at] + self.window), second(self.begin[at], self.begin[at] + self.window)


def _sliced(data: np.ndarray, window: int) -> Iterator[tuple[Parsed, int, np.ndarray]]:
    """A long text by slices, each with the window - 1 words after it: the words before it, and which windows begin in it.

    An anchor depends on what its window holds only, so it is the same in a slice as in the whole text.
    """
    before = 0
    for a, b, own in slices(data):
        end, step = b, 32 * window
        while end < len(data) and _words_in(data[b:end]) < window - 1:
            end, step = _break(data, end + step), 2 * step
        p = Parsed(data[a:end], window)
        yield p, before, np.flatnonzero(p.begin < own)
        before += own


def _is_long(batch: pa.RecordBatch) -> bool:
    """Whether a batch is one text that goes by slices; chunks() leaves long texts alone in theirs."""
    return batch.num_rows == 1 and len(common.text_bytes(batch.column("text"))[0]) > 2 * SLICE_BYTES


def _distinct(place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, by place."""
    order = np.lexsort((name, place))
    place, name = place[order], name[order]
    keep = np.ones(len(place), bool)
    keep[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1])
    return place[keep], name[keep]


def _long_anchors(data: np.ndarray, window: int) -> np.ndarray:
    """The names of one text's anchors, once for each place."""
    found = [(np.zeros(0, np.int64), np.zeros(0, _U))]
    for p, before, own in _sliced(data, window):
        place, name = p.anchors()
        found.append(_distinct(place[own] + before, name[own]))
    return _distinct(*[np.concatenate(x) for x in zip(*found, strict=True)])[1]


def _long_windows(data: np.ndarray, window: int, known: np.ndarray, whole: bool) -> list[np.ndarray]:
    """First word and both hashes of one text's windows whose anchors are known, or of all."""
    found = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))]
    for p, before, own in _sliced(data, window):
        at = own if whole else own[np.isin(p.anchors()[1][own], known)]
        if len(at):
            found.append((p.begin[at] + before, *p.hashes(at)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _long_cut(data: np.ndarray, window: int, begins: np.ndarray, copied: bool) -> tuple[int, int, bytes]:
    """The number of one text's words, of those that go, and the others joined."""
    cuts = list(slices(data))
    n = sum(own for *_, own in cuts)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + window, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    if copied and n >= window:
        gone[:] = True
    kept, before = [], 0
    for a, b, own in cuts:
        part = np.append(data[a:b], np.uint8(0x20))
        starts, ends, _ = common.word_spans(part, np.array([0, len(part)]))
        stay = ~gone[before : before + own]
        inside = np.zeros(len(part) + 1, np.int8)
        inside[starts[stay]] = 1
        inside[ends[stay] + 1] -= 1  # a word and the blank after it; the next word may begin there
        part[ends[stay]] = 0x20
        kept.append(part[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes())
        before += own
    return n, int(gone.sum()), b"".join(kept)[:-1]


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            if _is_long(batch):
                names = _long_anchors(common.text_bytes(batch.column("text"))[0], window)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2", "id")), common.lists(names, np.array([len(names)]), pa.int64())], ["t1", "t2", "id", "anchors"])
                continue
            p = Parsed(batch.column("text"), window)
            place, name = p.anchors()
            # One row of a list for each anchor's place; its name counts once for each place.
            keep = np.ones(len(place), bool)
            order = np.lexsort((place, p.row))
            r, q, m = p.row[order], place[order], name[order]
            keep[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (m[1:] != m[:-1])
            counts = np.bincount(r[keep], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2", "id")), common.lists(m[keep], counts, pa.int64())], ["t1", "t2", "id", "anchors"])

    return rows


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            keys = batch.column("anchors")
            known = np.unique(np.asarray(keys.flatten()).view(_U)) if len(keys.flatten()) else np.zeros(0, _U)
            whole = np.asarray(batch.column("whole").fill_null(False))
            if _is_long(batch):
                found = _long_windows(common.text_bytes(batch.column("text"))[0], window, known, bool(whole[0]))
                listed = [common.lists(x, np.array([len(x)]), pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2", "copies")), *listed], ["t1", "t2", "copies", "begin", "w1", "w2"])
                continue
            p = Parsed(batch.column("text"), window)
            wanted = whole | np.asarray(pc.greater(pc.fill_null(pc.list_value_length(keys), 0), 0))
            _, name = p.anchors()
            at = np.flatnonzero(wanted[p.row] & (whole[p.row] | np.isin(name, known)))
            w1, w2 = p.hashes(at)
            counts = np.bincount(p.row[at], minlength=batch.num_rows)
            begin = p.begin[at] - p.first[:-1][p.row[at]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("t1", "t2", "copies")), common.lists(begin, counts, pa.int64()), common.lists(w1, counts, pa.int64()), common.lists(w2, counts, pa.int64())], ["t1", "t2", "copies", "begin", "w1", "w2"]
            )

    return rows


def _cut_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            data, offs = common.text_bytes(batch.column("text"))
            if _is_long(batch):
                found = np.asarray(batch.column("begins").flatten()).astype(np.int64)
                n, removed, kept = _long_cut(data, window, found, bool(batch.column("copied").fill_null(False)[0].as_py()))
                columns = [pa.array([n], pa.int64()), pa.array([removed], pa.int64()), pa.array([kept], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_words", "n_removed", "kept"])
                continue
            starts, ends, first = common.word_spans(data, offs)
            n_words = np.diff(first)
            gone = np.zeros(len(starts) + 1, np.int64)
            begins = batch.column("begins")
            per = np.asarray(pc.fill_null(pc.list_value_length(begins), 0))
            at = np.asarray(begins.flatten()) + np.repeat(first[:-1], per) if per.sum() else np.zeros(0, np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
            copied = np.asarray(batch.column("copied").fill_null(False)) & (n_words >= window)
            gone = (np.cumsum(gone)[:-1] > 0) | np.repeat(copied, n_words)
            raw, kept = data.tobytes(), []
            s, e = starts.tolist(), ends.tolist()
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                part = range(a, b) if not per[i] and not copied[i] else (np.flatnonzero(~gone[a:b]) + a).tolist()
                kept.append(b" ".join([raw[s[j] : e[j]] for j in part]).decode())
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed[first[1:]] - removed[first[:-1]], pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows


def remove_repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept) for every row of docs.

    Words are separated by space and \\x09-\\x0D. A word goes if a window of so many consecutive words that covers it
    also starts anywhere else; all windows are judged on the input. kept: the other words, joined by one space. Null
    and empty texts have no words; texts shorter than a window stay whole; equal rows are copies of each other, so
    all their windows repeat. Ids may be null or repeat; other columns are not read. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    anchored = common.stage(keyed.mapInArrow(_anchor_rows(window), "t1 long, t2 long, id long, anchors array<long>"), "anchors")
    # Copies of a text stand together as one: (t1, t2) with its number; the row of the least id speaks for them.
    copies = anchored.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("speaker")).where("copies > 1")
    named = anchored.select("t1", "t2", F.explode("anchors").alias("anchor")).groupBy("anchor", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    repeated = common.stage(named.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    candidates = common.semi_join(named, repeated, ["anchor"]).groupBy("t1", "t2").agg(F.collect_list("anchor").alias("anchors"))
    info = common.stage(candidates.join(copies, ["t1", "t2"], "full"), "candidates")
    common.drop(anchored, repeated)
    # Windows are listed once for a text and its copies. If equal rows share the least id, each lists them: the sums only grow.
    speaking = keyed.join(info, ["t1", "t2"]).where(F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("speaker")))
    speaking = speaking.select("t1", "t2", F.coalesce("copies", F.lit(1)).alias("copies"), "text", "anchors", F.col("copies").isNotNull().alias("whole"))
    listed = common.stage(speaking.mapInArrow(_window_rows(window), "t1 long, t2 long, copies long, begin array<long>, w1 array<long>, w2 array<long>"), "windows")
    windows = listed.select("t1", "t2", "copies", F.explode(F.arrays_zip("begin", "w1", "w2")).alias("w")).select("t1", "t2", "copies", "w.begin", "w.w1", "w.w2")
    twice = common.stage(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1"), "twice")
    # Copies lose all windows anyway, so only texts that stand alone need to know theirs.
    alone = windows.where("copies = 1").select("t1", "t2", "begin", "w1", "w2")
    begins = common.semi_join(alone, twice, ["w1", "w2"]).groupBy("t1", "t2").agg(F.collect_set("begin").alias("begins"))
    verdict = common.stage(begins.join(info.where("copies > 1").select("t1", "t2", F.lit(True).alias("copied")), ["t1", "t2"], "full"), "verdicts")
    common.drop(listed, info, twice)
    judged = keyed.join(verdict, ["t1", "t2"], "left").select("id", "text", "begins", "copied")
    return judged.mapInArrow(_cut_rows(window), "id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE k IN (SELECT k FROM repeated)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(g, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
