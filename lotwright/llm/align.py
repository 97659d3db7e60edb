"""Alignment of two tokenizers' tokens on the same bytes, and corpus-wide counts of aligned id pairs.

Tokens of both sides are the nodes of a bipartite graph, edges join tokens that share a byte, and union-find gives its
connected components. These are the minimal groups: between two of them both sides end, within one they never do. Every
A token of a group is linked with every B token of it.

How many documents hold a pair linked is counted in Spark. A segment, some megabytes of documents that one task reads,
adds its documents up and sends each of its distinct pairs once, gets the corpus-wide counts of these back and looks
its links up in them; neither links nor documents' pairs are shuffled one by one.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Text aligned at once, and text of a segment.
CHUNK_BYTES, SEGMENT_BYTES = 1 << 20, 1 << 24
#: Words whose ids a Python worker keeps; with more, those not used lately go. Longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 48
#: Characters of a run of a longer text, which is worked through run by run.
RUN_CHARS = 1 << 20
#: Links of a group that are laid out one by one; a larger group is laid out by its distinct ids.
LAID_OUT = 4096
#: An id pair is one number: A's id above these bits.
_SHIFT = 32


def _byte_table(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, which shows bytes as printable characters."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = sorted(set(range(256)) - set(shown))
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


#: A space that stands alone between other characters: no token of either side reaches across its left edge.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_REACHES = re.compile(r"\S ")
#: Bytes that are white space by themselves, and what two- and three-byte white space begins and goes on with, with some other characters.
_BLANK, _TWO, _THREE, _THIRD = (np.isin(np.arange(256), x) for x in ([*range(9, 14), *range(28, 33)], [0x85, 0xA0], [0xE1, 0xE2, 0xE3], [0x80, 0x81, 0x9A]))
#: Words that are encoded as one text.
_TOGETHER = 64


def _runs(text: str) -> Iterator[str]:
    """A text in runs of RUN_CHARS at least, cut at spaces that stand alone, which are left out. Groups end there too."""
    at = 0
    while cut := _CUT.search(text, at + RUN_CHARS):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of spaces that stand alone inside texts in UTF-8; some beside characters of three bytes are left out."""
    space = data == 0x20
    space[offs[:-1][offs[:-1] < offs[1:]]] = space[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    at = np.flatnonzero(space)
    last, after = data[at - 1], data[at + 1]
    far = data[np.minimum(at + 2, len(data) - 1)]
    blank = _BLANK[last] | _BLANK[after] | (after == 0xC2) & _TWO[far] | _THREE[after] & _THIRD[far]
    near = data[np.maximum(at - 2, 0)]
    blank |= (near == 0xC2) & _TWO[last] | _THREE[data[np.maximum(at - 3, 0)]] & _THIRD[near]
    return at[~blank]


class Tokenizers:
    """Both tokenizers: ids of texts, bytes of ids, and how an id is written where it is not, or is, a side's last in a group.

    Neither side's tokens reach across a space that stands alone, but for its right; texts are cut there, and each word's
    ids are kept. Vocabularies for which that does not hold are refused.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        whole = {i for i in range(len(pieces)) if self.b.is_byte(i)}
        self.bytes_a = _byte_table(self.a.get_vocab())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if i in whole else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(_REACHES.search(x.decode(errors="replace")) for t in (self.bytes_a, [x for i, x in enumerate(self.bytes_b) if i not in whole]) for x in t):
            raise ValueError("a token that holds a space after another character")
        self.young: dict[str, tuple[bytes, bytes] | bool] = {}
        self.old: dict[str, tuple[bytes, bytes] | bool] = {}
        self.begins_a, self.begins_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.written = [np.array([f"{i}{end}" for i in range(len(t))], object) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends]

    def _side(self, words: list[str], begins: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. Words are encoded together where only they begin with a space."""
        if all(w and " " not in w and "▁" not in w and not w[0].isspace() and not w[-1].isspace() for w in words):
            every = np.fromiter(chain.from_iterable(encode([" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)])), "<u4")
            first = np.flatnonzero(begins[every])
            if len(first) == len(words) and first[:1] == [0]:
                return every, np.diff(np.append(first, len(every)))
        lists = encode(words)
        return np.fromiter(chain.from_iterable(lists), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists))

    def _of_words(self, words: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Ids of both sides as 32-bit numbers; False where their bytes are not a space and the word. All words are compared at once."""
        odd = [i for i, w in enumerate(words) if not w or " " in w or "▁" in w or w[0].isspace() or w[-1].isspace()]
        if odd and len(odd) < len(words):
            out, rest = [False] * len(words), sorted(set(range(len(words))).difference(odd))
            for part in (odd, rest):
                for i, ids in zip(part, self._of_words([words[i] for i in part]), strict=True):
                    out[i] = ids
            return out
        raw = [b" " + w.encode() for w in words]
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        fits, sides = np.ones(len(words), bool), []
        for begins, pieces, length, encode in (
            (self.begins_a, self.bytes_a, self.length_a, lambda texts: [e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]),
            (self.begins_b, self.bytes_b, self.length_b, lambda texts: self.b.encode(texts, num_threads=1)),
        ):
            every, counts = self._side(words, begins, encode)
            ends = np.cumsum(counts)
            sums = np.append(0, np.cumsum(length[every]))
            fits &= sums[ends] - sums[ends - counts] == sizes
            said = list(map(pieces.__getitem__, every.tolist()))
            if b"".join(said) != whole:
                fits &= np.fromiter((b"".join(said[e - n : e]) == x for e, n, x in zip(ends.tolist(), counts.tolist(), raw, strict=True)), bool, len(raw))
            data, ends = every.tobytes(), (4 * ends).tolist()
            sides.append([data[x:y] for x, y in zip([0, *ends], ends, strict=False)])
        return [(a, b) if fit else False for a, b, fit in zip(*sides, fits.tolist(), strict=True)]

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where there is no text or the ids' bytes are not a space and the text."""
        data, offs = common.text_bytes(pa.array([x or "" for x in texts], pa.large_string()))
        if not len(data):
            return tuple([np.zeros(0, np.int64)] * len(texts) for _ in range(2))
        gaps, some = _cuts(data, offs), offs[:-1] < offs[1:]
        starts, ends = (np.sort(np.concatenate(x)) for x in ((offs[:-1][some], gaps + 1), (offs[1:][some], gaps)))
        solid = np.ones(len(data), bool)
        solid[gaps] = False
        at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[solid])]).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()

        found = list(map(self.young.get, distinct))
        late = [i for i, x in enumerate(found) if x is None]
        for i in late:
            found[i] = self.old.get(distinct[i])
        missing = [i for i in late if found[i] is None]
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            for i, ids in zip(part, self._of_words([distinct[i] for i in part]), strict=True):
                found[i] = ids
        self.young.update((distinct[i], found[i]) for i in late if len(distinct[i]) <= KEPT_CHARS)
        if 2 * len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        first = np.searchsorted(starts, offs)  # each text's first word
        unfit = np.append(0, np.cumsum(np.fromiter((not x for x in found), bool, len(found))[codes]))[first]
        bad, out = np.repeat(unfit[1:] > unfit[:-1], np.diff(first)), []
        for side in (0, 1):
            own = [x[side] if x else b"" for x in found]
            sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
            counts = np.where(bad, 0, sizes[codes])
            ends = np.cumsum(counts)
            place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts)
            place += np.arange(len(place))
            every = np.frombuffer(b"".join(own), "<u4")[place].astype(np.int64)
            out.append(np.split(every, np.append(0, ends)[first[1:-1]]))
        return tuple(out)


def components(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find: for each node the least node that edges (left, right) connect it with.

    All edges are united at once: the roots of their ends are found by halving paths, the larger is hung below the
    smaller, and edges whose ends still differ go round again.
    """
    parent = np.arange(nodes)
    while len(left):
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while True:
            grand = parent[parent]
            if (grand == parent).all():
                break
            parent = grand
        left, right = parent[left], parent[right]
        apart = left != right
        left, right = left[apart], right[apart]
    return parent


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (A token, B token) of all that share a byte, from the ends of either side's tokens on the same bytes."""
    size = int(ends_a[-1]) if len(ends_a) else 0
    is_a, is_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    at = np.flatnonzero(is_a | is_b)  # each span up to the next end of either side lies in one token of each
    a_here, b_here = is_a[at], is_b[at]
    return np.cumsum(a_here) - a_here, np.cumsum(b_here) - b_here


class Groups:
    """The groups of some documents, whose tokens stand one after another: ids, group of each token, document of each group."""

    def __init__(self, tokenizers: Tokenizers, a_lists: list[np.ndarray], b_lists: list[np.ndarray]):
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a_lists, b_lists))
        self.n_a, self.n_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
        edges = overlaps(np.cumsum(tokenizers.length_a[self.a]), np.cumsum(tokenizers.length_b[self.b]))
        root = components(len(self.a) + len(self.b), edges[0], edges[1] + len(self.a))
        # A group's root is its first A token, so groups are numbered by their places.
        is_root = np.zeros(len(self.a) + 1, np.int64)
        is_root[root] = 1
        number = np.cumsum(is_root) - 1
        self.of_a, self.of_b = number[root[: len(self.a)]], number[root[len(self.a) :]]
        self.size = int(is_root.sum())
        self.in_a, self.in_b = np.bincount(self.of_a, minlength=self.size), np.bincount(self.of_b, minlength=self.size)
        self.doc = np.repeat(np.arange(len(a_lists)), self.n_a)[np.cumsum(self.in_a) - self.in_a] if self.size else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.doc, minlength=len(a_lists))
        self.n_links = np.zeros(len(a_lists), np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def texts(self, tokenizers: Tokenizers) -> list[str]:
        """Each document's groups as a1,a2|b1;a3|b2,b3."""
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        place_a = np.arange(len(self.a)) + start_b[self.of_a]
        place_b = np.arange(len(self.b)) + (start_a + self.in_a)[self.of_b]
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, place, of, inner, last in ((self.a, place_a, self.of_a, *tokenizers.written[:2]), (self.b, place_b, self.of_b, *tokenizers.written[2:])):
            ends = np.ones(len(ids), bool)
            ends[:-1] = of[1:] != of[:-1]
            out[place] = inner[ids]
            out[place[ends]] = last[ids[ends]]
        tokens = np.cumsum(self.n_a + self.n_b)
        return ["".join(out[e - n : e].tolist())[:-1] for e, n in zip(tokens.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, id pairs and how many links of the document are of that pair, by document and pair."""
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        links = self.in_a * self.in_b
        few = np.flatnonzero(links <= LAID_OUT)
        n = links[few]
        owner = np.repeat(few, n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        in_a, in_b = np.divmod(nth, self.in_b[owner])
        found = [_counted(self.doc[owner], self.a[start_a[owner] + in_a], self.b[start_b[owner] + in_b])]
        for g in np.flatnonzero(links > LAID_OUT).tolist():
            a, times_a = np.unique(self.a[start_a[g] : start_a[g] + self.in_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[start_b[g] : start_b[g] + self.in_b[g]], return_counts=True)
            keys, times = (a[:, None] << _SHIFT | b).ravel(), (times_a[:, None] * times_b).ravel()
            found.append((np.full(len(keys), self.doc[g]), keys, times))
        return found[0] if len(found) == 1 else _added_up(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _counted(docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, id pairs and how often each is there, by document and pair: sorted as one number each."""
    if not len(docs):
        return docs, a, docs
    all_a, all_b = int(a.max()) + 1, int(b.max()) + 1
    if (int(docs.max()) + 1) * all_a * all_b >= 1 << 63:
        return _added_up(docs, a << _SHIFT | b, np.ones(len(a), np.int64))
    every = (docs * all_a + a) * all_b + b
    every.sort()
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    rest, b = np.divmod(every[at], all_b)
    docs, a = np.divmod(rest, all_a)
    return docs, a << _SHIFT | b, np.diff(np.append(at, len(every)))


def _added_up(docs: np.ndarray, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(head)
    return docs[at], keys[at], np.add.reduceat(times[order], at) if len(at) else times[:0]


def _long_document(own: Tokenizers, text: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """The four counts, the groups' hash, the pairs and their links of one text, a run at a time."""
    counts, said, keys, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for n, run in enumerate(_runs(text)):
        a, b = own.ids([run])
        if not len(a[0]):
            return [0] * 4, "", keys[:0], times[:0]
        g = Groups(own, a, b)
        counts += [g.n_a[0], g.n_b[0], g.n_groups[0], g.n_links[0]]
        said.update(((";" if n else "") + g.texts(own)[0]).encode())
        _, more, again = g.pairs()
        keys, times = np.concatenate([keys, more]), np.concatenate([times, again])
        _, keys, times = _added_up(np.zeros(len(keys), np.int64), keys, times)
    return counts.tolist(), said.hexdigest(), keys, times


_loaded: dict = {}


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, nth, a_ids, b_ids): the groups of every text in order.

    Texts that are null or empty, or that one side does not give back byte for byte, have none. Nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers((a_path, b_path))
        for batch in common.chunks(batches, "text", CHUNK_BYTES):
            if batch.num_rows == 1 and len(text := batch.column("text")[0].as_py()) > 2 * RUN_CHARS:
                if all(len(own.ids([run])[0][0]) for run in _runs(text)):  # one run that does not come back is enough for no groups
                    before = 0
                    for run in _runs(text):
                        g = Groups(own, *own.ids([run]))
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(g.doc)), pa.array(np.arange(before, before + g.size)), common.lists(g.a.astype(np.int32), g.in_a, pa.int32()), common.lists(g.b.astype(np.int32), g.in_b, pa.int32())], schema=schema)
                        before += g.size
                continue
            g = Groups(own, *own.ids(batch.column("text").to_pylist()))
            nth = np.arange(g.size) - np.repeat(np.cumsum(g.n_groups) - g.n_groups, g.n_groups)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(g.doc)), pa.array(nth), common.lists(g.a.astype(np.int32), g.in_a, pa.int32()), common.lists(g.b.astype(np.int32), g.in_b, pa.int32())], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(rows, "doc_id long, nth long, a_ids array<int>, b_ids array<int>")


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.int64())])
_SEGMENT = pa.schema([("segment", pa.int64()), ("docs", pa.binary()), ("links", pa.binary()), ("keys", pa.binary()), ("held", pa.binary())])
_SEGMENT_DDL = "segment long, docs binary, links binary, keys binary, held binary"


def _table_bytes(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return out.getvalue()


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers by planes of bytes, compressed."""
    raw = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _segments(a_path: str, b_path: str, segment_bytes: int):
    """Rows of segments: documents, their links as places in the segment's sorted pairs, the pairs, documents that hold each."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, nth = _tokenizers((a_path, b_path)), 0
        docs, keys, times, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            all_keys = np.concatenate(keys)
            distinct, place, n = np.unique(all_keys, return_inverse=True, return_counts=True)
            name = TaskContext.get().partitionId() << 32 | nth
            # Within a document places rise, so differences are small; they wrap around where the next one begins.
            links = _packed(np.diff(place, prepend=0), "<u4"), _packed(np.concatenate(times), "<u8")
            row = (name, _table_bytes(docs), len(links[0]).to_bytes(8, "little") + links[0] + links[1], distinct.astype("<i8").tobytes(), n.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SEGMENT.types, strict=True)], schema=_SEGMENT)

        for batch in common.chunks(batches, "text", CHUNK_BYTES):
            if batch.num_rows == 1 and len(text := batch.column("text")[0].as_py()) > 2 * RUN_CHARS:
                counts, said, pairs, n = _long_document(own, text)
                columns = [batch.column("id"), *[[x] for x in counts], [said], [len(pairs)]]
            else:
                g = Groups(own, *own.ids(batch.column("text").to_pylist()))
                of, pairs, n = g.pairs()
                sums = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in g.texts(own)]
                columns = [batch.column("id"), g.n_a, g.n_b, g.n_groups, g.n_links, sums, np.bincount(of, minlength=batch.num_rows)]
            docs.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _DOCS.types, strict=True)], schema=_DOCS))
            keys.append(pairs)
            times.append(n)
            held += batch.column("text").nbytes
            if held >= segment_bytes:
                yield segment()
                docs, keys, times, held, nth = [], [], [], 0, nth + 1
        if docs:
            yield segment()

    return segments


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, keys, held in zip(batch.column("segment").to_pylist(), batch.column("keys"), batch.column("held"), strict=True):
            keys, held = np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(held.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), name)), pa.array(keys), pa.array(held)], ["segment", "pair", "held"])


def staged_segments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Rows (segment, docs, links, keys, held) of segments of at least segment_bytes of text, but for each task's last."""
    return common.stage(_rows(docs, id_col, text_col).mapInArrow(_segments(a_path, b_path, segment_bytes), _SEGMENT_DDL), "segments", "none")


def pair_counts(segments: DataFrame) -> DataFrame:
    """Rows (pair, docs): in how many documents each id pair is linked, over a table of staged_segments.

    a_of and b_of take pair apart. A document counts once; repeated rows count each.
    """
    held = segments.select("segment", "keys", "held").mapInArrow(_count_rows, "segment long, pair long, held long")
    return held.groupBy("pair").agg(F.sum("held").alias("docs"))


def a_of(pair) -> Column:
    return F.shiftright(pair, _SHIFT)


def b_of(pair) -> Column:
    return (F.col(pair) if isinstance(pair, str) else pair).bitwiseAND(F.lit((1 << _SHIFT) - 1))


def _digest(segment: pa.Table, counts: pa.Table) -> pa.Table:
    if not segment.num_rows:
        return pa.table([pa.array([], t) for t in _OUT.types], schema=_OUT)
    order = np.argsort(counts.column("pair").to_numpy())
    docs_of, best = counts.column("docs").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    with pa.ipc.open_stream(segment.column("docs")[0].as_py()) as r:
        docs = r.read_all().combine_chunks()
    links = segment.column("links")[0].as_py()
    n = int.from_bytes(links[:8], "little")
    place = np.cumsum(_unpacked(links[8 : 8 + n], "<u4"), dtype=np.uint32).astype(np.int64)
    times = _unpacked(links[8 + n :], "<u8").astype(np.int64)
    sums = [np.zeros(len(place) + 1, np.int64) for _ in range(2)]
    np.cumsum(times * docs_of[place], out=sums[0][1:])
    np.cumsum(times * best[place], out=sums[1][1:])
    ends = np.cumsum(docs.column("pairs").to_numpy())
    starts = ends - docs.column("pairs").to_numpy()
    count_sum, n_best = (s[ends] - s[starts] for s in sums)
    return pa.table([*[docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(n_best), pa.array(count_sum), docs.column("groups_sha256")], schema=_OUT)


_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each document: n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its A id exceeds),
    count_sum (documents that hold a link's pair, over links) and groups_sha256.

    Texts without tokens (null, empty, or not given back byte for byte by both sides) have zeros and an empty
    groups_sha256. A null doc_id is kept; repeated rows are documents of their own; other columns are not read; an empty
    table gives none. The highest count of an A id is broadcast: a row for each id of its vocabulary at most.
    """
    segments = staged_segments(docs, a_path, b_path, id_col, text_col, segment_bytes)
    held = segments.select("segment", "keys", "held").mapInArrow(_count_rows, "segment long, pair long, held long")
    counts = common.stage(held.groupBy("pair").agg(F.sum("held").alias("docs")), "pairs")
    highest = counts.groupBy(a_of("pair").alias("a")).agg(F.max("docs").alias("most"))
    judged = counts.join(F.broadcast(highest), a_of("pair") == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = held.select("segment", "pair").join(judged, "pair")
    one = segments.select("segment", "docs", "links").groupBy("segment").cogroup(back.groupBy("segment"))
    return one.applyInArrow(_digest, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
