"""Best-fit packing of token sequences.

The packing is best-fit decreasing: pieces by falling length, each into the open sequence with the least room that
still holds it, found by a segment tree over remaining capacities. Pieces of one length are alike, so the packing is
planned over the histogram of lengths (max_tokens values at most, whatever the corpus) and says for every length which
ranks go to which run of sequences; the pieces themselves never meet in one place.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_TOKENS = 4096
END_ID = 1
#: Salts a length is ranked in; a length that a third of all pieces have is then ranked in as many parts.
PIECES_PER_SALT = 2000


class CapacityTree:
    """Segment tree over capacities 0..top: tightest(c) is the least open capacity of at least c, in logarithmic time."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = self.size + capacity
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, capacity: int) -> int | None:
        i = self.size + capacity
        if self.open[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i >>= 1
        return None


def plan_packing(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, rank, per_bin, bin, offset): pieces of this length from this rank on go per_bin to a sequence, the
    first to sequence bin at offset, up to the next row's rank. The same packing as piece by piece.
    """
    tree, runs, rows, bins = CapacityTree(max_tokens), defaultdict(list), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count:
            runs[capacity].append((first, count))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = max_tokens
                need = -(-left // (room // length))
                put(room, bins, need)
                bins += need
            first, count = runs[room].pop()
            tree.add(room, -count)
            per = room // length
            full = min(count, left // per)
            if full:
                rows.append((length, rank, per, first, max_tokens - room))
                put(room - per * length, first, full)
                left, rank, first, count = left - full * per, rank + full * per, first + full, count - full
            if left and count:  # fewer are left than one sequence takes
                rows.append((length, rank, left, first, max_tokens - room))
                put(room - left * length, first, 1)
                left, first, count = 0, first + 1, count - 1
            put(room, first, count)
    return rows


#: Parts of words that a Python worker keeps the ids of; with more, all go and those of the next batch are kept.
KEPT_PARTS = 1_000_000
#: Bytes of text that are encoded at once; a longer text is cut at white space, which no token of the vocabulary spans.
ENCODED_BYTES = 1 << 22
#: What a byte belongs to: white space, a letter, the first byte of a digit, a sign, what only the tokenizer knows, the rest of a digit.
_GAP, _LETTER, _DIGIT, _SIGN, _OTHER, _REST = range(6)


def _kind(c: int) -> int:
    """Of a code point: letters, digits and signs are U+0021 to U+024F whose lower case is in UTF-8 no longer."""
    x = chr(c)
    if c == 0x20 or 9 <= c <= 13:
        return _GAP
    if not 0x21 <= c < 0x250 or 0x7F <= c <= 0xA0 or c == 0x130 or len(x.lower().encode()) != len(x.encode()):
        return _OTHER
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(x)[0], _SIGN)


_KIND = np.array([_kind(c) for c in range(0x800)], np.int8)
_LOWER = np.array([ord(chr(c).lower()) if _KIND[c] == _LETTER else c for c in range(0x800)])
_BYTE_KIND = np.where(np.arange(256) < 0x80, _KIND[:256], _OTHER).astype(np.int8)
_BYTE_LOWER = np.where(np.arange(256) < 0x80, _LOWER[:256], np.arange(256)).astype(np.uint8)
#: The same for bytes.translate, which is faster than numpy's look-up.
_KIND_TABLE, _LOWER_TABLE = _BYTE_KIND.tobytes(), _BYTE_LOWER.tobytes()
_GAPS = bytes(np.flatnonzero(_BYTE_KIND == _GAP).tolist())
_AFTER_APOSTROPHE = np.isin(np.arange(256), list(b"strvmld"))
_encoders: dict = {}


class _Encoder:
    """From texts to ids, equal to the tokenizer's own encoding.

    The vocabulary's rules never look across white space. A word of Latin letters, digits and ASCII signs falls, in lower
    case, into runs of letters, single digits and runs of signs, as the file's own pre-tokenizer has it; a word with
    other characters, a short form after an apostrophe or the beginning of a special token stays whole and goes to the
    tokenizer. numpy finds these parts in a batch of texts, Arrow the different ones, whose ids are looked up and kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._forget()
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _numbers(self, parts: list[bytes], whole: np.ndarray) -> np.ndarray:
        """Where the ids of different parts are kept: part n has sizes[n] of them from places[n] on. New parts are tokenized."""
        found = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        late = np.flatnonzero(found < 0)
        if not len(late):
            return found
        if self.known and len(self.known) + len(late) > KEPT_PARTS:
            self._forget()
            found[:], late = -1, np.arange(len(parts))
        new, ids, sizes, tokenize = list(map(parts.__getitem__, late.tolist())), [], [], self.tok.model.tokenize
        for x, is_whole in zip(new, whole[late].tolist(), strict=True):
            if is_whole:
                own = self.tok.encode(x.decode(), add_special_tokens=False).ids
            else:
                shown = x.decode("latin1")
                own = [t.id for t in tokenize(shown if x.isascii() else shown.translate(self.table))]
            ids += own
            sizes.append(len(own))
        found[late] = numbers = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, numbers.tolist(), strict=True))
        ends = np.cumsum(np.array(sizes, np.int64))
        self.places = np.append(self.places, len(self.ids) + ends - sizes)
        self.sizes = np.append(self.sizes, np.array(sizes, np.int64))
        self.ids = np.append(self.ids, np.array(ids, "<u4"))
        return found

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.places, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that are not all empty: their ids, one after another, and how many each has."""
        raw = data.tobytes()
        kind, low = np.frombuffer(bytearray(raw.translate(_KIND_TABLE)), np.int8), np.frombuffer(bytearray(raw.translate(_LOWER_TABLE)), np.uint8)
        wide = np.flatnonzero((data & 0xE0) == 0xC0)  # first of two bytes
        code = (data[wide].astype(np.int64) & 0x1F) << 6 | data[wide + 1] & 0x3F
        kind[wide] = of = _KIND[code]
        kind[wide + 1] = np.where(of == _DIGIT, _REST, of)
        code = _LOWER[code]
        low[wide], low[wide + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F

        solid = kind != _GAP
        start, first = kind == _DIGIT, solid.copy()  # of a part, of a word
        start[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != _REST)
        first[1:] &= ~solid[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = solid[heads]
        start |= first
        start &= solid

        # Words that stay whole.
        sign, special = np.flatnonzero(data[:-1] == 0x27), np.flatnonzero(data[:-1] == 0x3C)
        odd = np.concatenate([np.flatnonzero(kind == _OTHER), sign[_AFTER_APOSTROPHE[low[sign + 1]]], special[data[special + 1] == 0x7C]])
        begins = np.zeros(0, np.int64)
        if len(odd):
            words, gaps = np.flatnonzero(first), np.append(np.flatnonzero(~solid), len(data))
            nth = np.unique(np.searchsorted(words, odd, side="right") - 1)
            begins = words[nth]
            ends = np.minimum(np.append(words, len(data))[nth + 1], gaps[np.searchsorted(gaps, begins)])
            change = np.zeros(len(data) + 1, np.int8)
            np.add.at(change, begins, 1)
            np.add.at(change, ends, -1)
            inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
            start &= ~inside | first
            low = np.where(inside, data, low)

        starts = np.flatnonzero(start)
        packed = low.tobytes().translate(None, _GAPS)  # all but white space, and where parts start in it
        at = np.flatnonzero(np.frombuffer((start.view(np.uint8) + 2 * (~solid).view(np.uint8)).tobytes().translate(None, b"\x02"), bool))
        at = np.append(at, len(packed)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
        codes, whole = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
        whole[codes[np.searchsorted(starts, begins)]] = True
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)

        # From the ids of the different parts those of all parts.
        places, counts = self.places[numbers], self.sizes[numbers][codes]
        ends = np.cumsum(counts)
        place = np.repeat(places[codes] - (ends - counts), counts)
        place += np.arange(len(place))
        return self.ids[place], np.diff(np.append(0, ends)[np.searchsorted(starts, offs)])

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; null is empty."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        data, offs = common.text_bytes(texts)
        lo = 0
        while lo < len(texts):
            hi = max(int(np.searchsorted(offs, offs[lo] + ENCODED_BYTES, side="right")) - 1, lo + 1)
            own = data[offs[lo] : offs[hi]]
            if hi == lo + 1:
                ids.append(self(own.tobytes()))
                counts.append(np.array([len(ids[-1])]))
            elif len(own):
                got = self._batch(own, offs[lo : hi + 1] - offs[lo])
                ids.append(got[0])
                counts.append(got[1])
            else:
                counts.append(np.zeros(hi - lo, np.int64))
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def __call__(self, raw: bytes) -> np.ndarray:
        """The ids of one text in UTF-8."""
        out, at, data = [np.zeros(0, "<u4")], 0, np.frombuffer(raw, np.uint8)
        while at < len(raw):
            end = min(at + ENCODED_BYTES, len(raw))
            while end < len(raw) and raw[end] not in b" \t\n\r\v\f":
                end += 1
            out.append(self._batch(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Token ids of every text, then END_ID, cut into pieces of max_tokens; the last piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in common.chunks(batches, "text", ENCODED_BYTES):
            rows, at = [], 0
            every, counts = encode.rows(batch.column("text"))
            for key, n in zip(batch.column("id").to_pylist(), counts.tolist(), strict=True):
                ids, at = np.append(every[at : at + n], np.uint32(END_ID)).astype("<u4"), at + n
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    out = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Give each row of pieces (column length, 1..max_tokens, others kept) a sequence_id and an offset.

    pieces is read twice and must give the same rows again, so pass a table. Rows of one length are numbered within
    salts, whose counts are then added up, so a common length is spread over tasks. The driver sees only the histogram
    of lengths and the plan, both bounded by max_tokens. An empty table gives an empty table;
    columns that have the names of new ones or of _salt, _rank, _before, _n and _at are replaced.
    """
    spark, pieces = pieces.sparkSession, common.without(pieces, "sequence_id", "offset", "_salt", "_rank", "_before", "_n", "_at")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_packing(histogram, max_tokens)
    starts = np.array([(-r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
    table = np.array([(r[2], r[3], r[4]) for r in rows], np.int64).reshape(-1, 3)
    # One sorted key for (length falling, rank): ranks stay below the number of pieces.
    width = max(histogram.values(), default=1) + 1
    keys = (starts[:, 0] + max_tokens) * width + starts[:, 1]
    shared = spark.sparkContext.broadcast((keys, table, width))
    salts = max(16, sum(histogram.values()) // PIECES_PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32"))).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_salt", "_before")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table, width = shared.value
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = (max_tokens - size) * width + rank
        at = np.searchsorted(keys, key, side="right") - 1
        per, first, offset = table[at].T
        nth = key - keys[at]
        return pd.DataFrame({"sequence_id": first + nth // per, "offset": offset + nth % per * size})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack the documents (doc_id, text; other columns are dropped) into as few sequences as best fit decreasing needs.

    One row for each piece. Null and empty texts are one piece holding END_ID; a null doc_id is kept; equal rows are
    packed once each; an empty table gives none.
    """
    pieces = common.stage(tokenize_pieces(docs, tokenizer, max_tokens=max_tokens, with_ids=with_ids), "pieces")
    return pack(pieces, max_tokens).withColumnRenamed("id", "doc_id")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
