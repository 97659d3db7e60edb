"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, these into longer phrases, and so on. In each level runs of one symbol become
one symbol; deterministic coin tossing then gives every symbol a small label from how it differs from its left
neighbour (the lowest differing bit and its value), and again from the labels, until labels are below six; local
maxima of the labels start phrases. Where a phrase starts depends on a few neighbours only, so equal substrings have
equal phrases inside, at whatever offset they stand. A phrase's name is a hash of what it spells. The fingerprint holds
the KEPT least ranks of all levels' names, a rank being the name's hash times STEP for each level below the last: long
texts are told by their long phrases, of which they have enough, short ones by all the phrases they have. Likeness is
the share of common ranks among the least of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Spans, mix

LEVELS = 3
KEPT = 64
#: Bits by which a lower level's ranks lie higher; a level has some 2**2 times the phrases of the next.
STEP_BITS = 4
#: Bits of a rank: 32 for the last level.
RANK_BITS = 32 + STEP_BITS * (LEVELS - 1)
#: Bytes of the input for each range that texts are dealt out by.
RANGE_BYTES = 64 << 20
#: Texts of more bytes are parsed by blocks of so many, so that memory does not grow with them.
BLOCK_BYTES = 1 << 19
#: Runs before a block that decide where phrases start in it: each of five tosses looks one run to the left, a maximum one more.
CONTEXT = 8
_U = np.uint64


def _coin_table(size: int) -> np.ndarray:
    """The label of symbol y after x, both below size: twice the lowest place where they differ, and y's bit there."""
    x, y = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = x ^ y
    place = np.bitwise_count(((differ & -differ) - 1) & 0xFF)
    return np.where(differ == 0, 0, 2 * place + (y >> place & 1)).astype(np.uint8)


_TABLE = _coin_table(256).ravel()


def _toss(labels: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A round of coin tossing over labels below 256; a text's first symbol keeps a label of its own."""
    pair = labels.astype(np.uint16)
    pair[1:] |= labels[:-1].astype(np.uint16) << 8
    out = _TABLE[pair]
    out[heads] = labels[heads] & 1
    return out


def phrase_starts(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where phrases start in symbols, of which no two neighbours in one text are equal. heads: first symbols of texts."""
    if symbols.dtype != np.uint8:
        differ = np.empty_like(symbols)
        differ[0] = 1
        np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
        place = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)).astype(np.uint8)
        labels = 2 * place + (symbols >> place.astype(_U) & _U(1)).astype(np.uint8)
        labels[heads] = 0
        labels = _toss(labels, heads)
    else:
        labels = symbols
    for _ in range(3):
        labels = _toss(labels, heads)
    start = np.zeros(len(symbols), bool)
    # A maximum inside its text; neighbours' labels differ but for a text's first ones.
    start[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    start[heads[1:] - 1] = False
    start[heads] = True
    after = heads[heads + 1 < len(symbols)] + 1
    start[after] = np.isin(after, heads)
    return np.flatnonzero(start)


def names(data: np.ndarray, offs: np.ndarray, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the names of all phrases, text by text, where they begin, and each text's offsets in them."""
    if not len(data):
        return
    spell = Spans(common.BYTE[data], 3)
    symbols, begins = data, None
    firsts = np.unique(offs[:-1][offs[:-1] < offs[1:]])
    heads = firsts
    for _ in range(levels):
        first = np.zeros(len(symbols), bool)
        first[heads] = True
        keep = first.copy()
        keep[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(keep)  # runs
        begins = at if begins is None else begins[at]
        times = np.diff(np.append(at, len(symbols)))
        kept, heads = symbols[at], np.flatnonzero(first[at])
        if kept.dtype != np.uint8:
            kept = np.where(times > 1, mix(kept + times.astype(_U)), kept)
        # A byte's run keeps the byte: what two neighbouring runs are of still differs.
        starts = phrase_starts(kept, heads)
        begins = begins[starts]
        symbols = spell(begins, np.append(begins[1:], len(data)))
        heads = np.searchsorted(begins, firsts)
        yield symbols, begins, np.searchsorted(begins, offs)


def ranks(names: np.ndarray, level: int) -> np.ndarray:
    """Ranks of names of a level, 1 to LEVELS: the last level's are below 2**32, each lower one's reach STEP_BITS higher."""
    return (mix(names + _U(17)) >> _U(64 - 32 - STEP_BITS * (LEVELS - level))).astype(np.int64)


def sketches(levels: list[tuple[np.ndarray, np.ndarray]], texts: int, kept: int = KEPT) -> list[np.ndarray]:
    """For each of so many texts the least distinct ranks of its names of all levels (names, offsets), rising."""
    parts = [(np.repeat(np.arange(texts), np.diff(offs)) << RANK_BITS) + ranks(names, level) for level, (names, offs) in enumerate(levels, 1)]
    order = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]))
    at = np.searchsorted(order, np.arange(texts + 1) << RANK_BITS)
    low = order & ((1 << RANK_BITS) - 1)
    return [low[a : min(b, a + kept)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of common ranks among the least of both; two texts without names are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


def _phrases(blocks: Blocks) -> Iterator[np.ndarray]:
    """Where the phrases of one text start, of its symbols and their first bytes given block by block."""
    held = before = None  # the run that may go on: symbol, first byte, length; decided runs and those after them
    lo = 0  # the first run of before that is not decided

    def decided(before, last: bool):
        nonlocal lo
        symbols, begins = before
        hi = len(symbols) if last else len(symbols) - 1
        if hi <= lo:
            return before, begins[:0]
        starts = phrase_starts(symbols, np.zeros(1, np.int64))
        starts = begins[starts[(starts >= lo) & (starts < hi)]]
        cut = max(0, hi - CONTEXT)
        lo = hi - cut
        return (symbols[cut:], begins[cut:]), starts

    def joined(before, symbols, begins, times):
        if symbols.dtype != np.uint8:
            symbols = np.where(times > 1, mix(symbols + times.astype(_U)), symbols)
        return (symbols, begins) if before is None else (np.concatenate([before[0], symbols]), np.concatenate([before[1], begins]))

    for symbols, begins in blocks:
        new = np.ones(len(symbols), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        new[0] = held is None or symbols[0] != held[0][0]
        at = np.flatnonzero(new)
        if not len(at):
            held = (*held[:2], held[2] + len(symbols))
            continue
        runs = symbols[at], begins[at], np.diff(np.append(at, len(symbols)))
        if held is not None:
            runs = tuple(np.concatenate([h, r]) for h, r in zip((*held[:2], held[2] + at[0]), runs, strict=True))
        held = tuple(r[-1:] for r in runs)
        if len(runs[0]) > 1:
            before, starts = decided(joined(before, *[r[:-1] for r in runs]), False)
            if len(starts):
                yield starts
    if held is not None:
        _, starts = decided(joined(before, *held), True)
        if len(starts):
            yield starts


def _spelt(data: np.ndarray, phrases: Iterator[np.ndarray]) -> Blocks:
    """The names of one text's phrases, which are those of Spans over all of it, and where they begin."""
    moduli = [(base, pow(base, -1, common._PRIME)) for base in common.bases(3)]
    at, sums, known = 0, [0, 0], None  # summed up to here; known: first byte, sum and inverse power where the last phrase begins
    times = lambda x, k: common._residue(common._fold(x * _U(k)))

    def marks(bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both polynomials the sums before these bytes, which are at or after those of earlier calls, and inverse powers there."""
        nonlocal at
        out = [[], []]
        done = 0
        while done < len(bounds):
            size = min(BLOCK_BYTES, len(data) - at)
            end = at + size if bounds[-1] >= at + size else int(bounds[-1])
            here = bounds[done : int(np.searchsorted(bounds, end, side="right"))]
            done += len(here)
            values = common.BYTE[data[at:end]]
            for k, ((base, inverse), part) in enumerate(zip(moduli, (values & _U(common._PRIME), values >> _U(33)), strict=True)):
                up, down = common.powers(base, BLOCK_BYTES + 1)
                local = np.zeros(end - at + 1, _U)
                np.cumsum(common._fold(part * up[: end - at]), out=local[1:])
                whole = times(common._residue(local[np.append(here - at, end - at)]), pow(base, at, common._PRIME)) + _U(sums[k])
                whole = common._residue(whole)
                out[k].append((whole[:-1], times(down[here - at].copy(), pow(inverse, at, common._PRIME))))
                sums[k] = int(whole[-1])
            at = end
        return [tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in out]

    def named(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known
        found = marks(bounds)
        if known is not None:
            bounds = np.concatenate([known[0], bounds])
            found = [tuple(np.concatenate(x) for x in zip(*pair, strict=True)) for pair in zip(known[1], found, strict=True)]
        known = bounds[-1:], [(s[-1:], d[-1:]) for s, d in found]
        a, b = (common._residue(common._fold(common._residue(s[1:] + _U(common._PRIME) - s[:-1]) * d[:-1])) for s, d in found)
        return mix((a << _U(31) | b) + np.diff(bounds).astype(_U) * _U(0x9E3779B97F4A7C15)), bounds[:-1]

    for starts in phrases:
        block = named(starts)
        if len(block[0]):
            yield block
    if known is not None:
        yield named(np.array([len(data)]))


def long_sketch(data: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The fingerprint of one text of any length, the same as that of sketches, in memory of some blocks."""
    least = np.zeros(0, np.int64)

    def ranked(level: int, blocks: Blocks) -> Blocks:
        nonlocal least
        for found, begins in blocks:
            least = np.unique(np.concatenate([least, ranks(found, level)]))[:kept]
            yield found, begins

    blocks = ((data[i : i + BLOCK_BYTES], np.arange(i, min(i + BLOCK_BYTES, len(data)))) for i in range(0, len(data), BLOCK_BYTES))
    for level in range(1, LEVELS + 1):
        blocks = ranked(level, _spelt(data, _phrases(blocks)))
    for _ in blocks:
        pass
    return least


def fingerprint_texts(col: pa.Array) -> list[np.ndarray]:
    data, offs = common.text_bytes(col)
    long = np.flatnonzero(np.diff(offs) > 2 * BLOCK_BYTES)
    if not len(long):
        return sketches([(found, at) for found, _, at in names(data, offs)], len(col))
    out, lo = [], 0
    for i in [*long.tolist(), len(col)]:  # the texts between long ones, then the long one
        part = data[offs[lo] : offs[i]]
        out += sketches([(found, at) for found, _, at in names(part, offs[lo : i + 1] - offs[lo])], i - lo)
        if i < len(col):
            out.append(long_sketch(data[offs[i] : offs[i + 1]]))
        lo = i + 1
    return out


def as_text(sketch: np.ndarray) -> str:
    """RANK_BITS / 4 hexadecimal digits for each rank."""
    return "".join(f"{x:0{RANK_BITS // 4}x}" for x in sketch.tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint) for every row of docs: up to KEPT ranks of ten hexadecimal digits. Null counts as empty,
    whose fingerprint is empty; a null id is kept; other columns are not read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([as_text(x) for x in fingerprint_texts(batch.column("text"))], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "id long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], nexts: list[str], prints: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """The rows of documents whose next ones are known; prints: fingerprints of texts and of the last of nexts."""
    if prints is None:
        prints = fingerprint_texts(pa.array(texts, pa.string()))
        after = fingerprint_texts(pa.array(nexts, pa.string()))
    else:
        after = prints[1:]
    edited = []
    for text, following in zip(texts, nexts, strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    other = fingerprint_texts(pa.array(edited, pa.string()))
    rows = [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(p), as_text(o), likeness(p, o), likeness(p, n))
        for i, t, e, p, o, n in zip(ids, texts, edited, prints, other, after, strict=False)
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text; others are not read) its fingerprint, that of its edited text, and likenesses.

    Edited: the last floor(n/2) of n code points give way to the first as many of the next document. Documents go by
    doc_id, null first, equal ids by a hash of the text; after the last comes the first, which for one document is itself.
    Null texts are empty; equal texts have equal fingerprints; an empty table gives none. Texts are dealt out once by
    ranges of doc_id; where a range ends, the next one's first document is looked up in a table of two rows a range.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.scanned_bytes(docs) // RANGE_BYTES)
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("place", F.spark_partition_id())

    schema = pa.schema([*_OUT, ("place", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])

    def edge(place: int, kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        row = dict.fromkeys(schema.names) | {"place": place, "kind": kind, "doc_id": doc_id, "text": text}
        return pa.RecordBatch.from_pylist([row], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0  # the document whose next one is not known yet, with its fingerprint
        for batch in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            prints = fingerprint_texts(batch.column("text"))
            if held is None:
                place = batch.column("place")[0].as_py()
                yield edge(place, 1, ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            if len(ids) > 1:
                out = _compare(ids[:-1], texts[:-1], texts[1:], prints)
                k = out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(k, pa.int32()), pa.array([0] * k, pa.int32()), pa.nulls(k, pa.string())], schema=schema)
            held = (ids[-1], texts[-1], prints[-1])
        if held is not None:
            yield edge(place, 2, held[0], held[1])

    done = common.stage(ordered.mapInArrow(rows, _TYPES + ", place int, kind int, text string"), "fingerprints")
    edges = done.where("kind > 0").select("place", "kind", "doc_id", "text")
    # Which range follows which: two small numbers for each range.
    places = sorted(r[0] for r in edges.where("kind = 1").select("place").collect())
    follows = spark.createDataFrame(list(zip(places, [*places[1:], *places[:1]], strict=True)), "place int, next int")
    first = edges.where("kind = 1").select(F.col("place").alias("next"), F.col("text").alias("next_text"))
    last = edges.where("kind = 2").join(follows, "place").join(first, "next").select("doc_id", "text", "next_text")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            yield _compare(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))

    return done.where("kind = 0").select(*_OUT.names).union(last.mapInArrow(ends, _TYPES))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
