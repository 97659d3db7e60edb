"""Token ids in files of their own format: shards of independently reset, checksummed, range-coded blocks.

The coder mixes the predictions of three orders. Order 2 and order 1 each foresee one id, the last one seen after the
same two ids or the same one; order 0 gives every id seen in the block a share by its frequency; a fourth source gives
any id of the vocabulary an equal share. The sources' weights are learnt, for each confidence of the two foreseen ids,
while the block is coded, and the arithmetic coder narrows its range by the weight and then by the share. All is
integer arithmetic, so encoder and decoder agree on any machine.

Blocks know nothing of each other, so a shard's blocks are coded in step: each step handles one id of every block with
numpy, and Python's cost is shared by some thousand blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packing import ENCODED_BYTES, _encoder

END_ID = 2
#: Ids of a shard, after which it is closed at the end of a document.
SHARD_IDS = 1 << 23
#: Blocks that a shard aims at, and the bounds of a block's ids.
LANES, LEAST_BLOCK, MOST_BLOCK = 4096, 512, 1 << 14
#: Blocks that are set in order at once.
_AT_ONCE = 256
#: Steps after which what blocks let go is taken up.
_STEPS = 64
#: Blocks whose ids are ranked by one table.
_LOOKED_UP = 8
_MAGIC, _VERSION = b"IDBLOCKS", 3
_HEAD = struct.Struct("<8sIIQQQI")  # magic, version, ids of a block, ids of the vocabulary, documents, ids, blocks
_NULL_DOC = -(1 << 63)

_U = np.uint64
#: The coder's low end and range are 64 bits; 16 leave at once where they are settled, or the range is below the floor.
_SETTLED, _FLOOR = _U(1 << 48), _U(1 << 40)
#: Weights of the sources add up to 2**16: order 2, order 1, order 0, any id.
_ANY = 3
_WEIGHT_BITS, _LEARN = 16, 5
#: By the version of the format, of which files are written in the last and read in any: slots of the foreseen ids of order 1
#: and 2 of each block, after what growth of the ids seen their frequencies are summed up, every how many ids weights are learnt.
_MODELS = {2: (1 << 9, 1 << 10, (5, 4), 1), 3: (1 << 8, 1 << 9, (2, 1), 4)}


def _first_weights() -> np.ndarray:
    """For each confidence (order 2, order 1, whether they foresee the same id): weights before anything is learnt."""
    out = np.zeros((4, 4, 2, 4), np.int64)
    for two in range(4):
        for one in range(4):
            out[two, one, :, 0] = (1, 12000, 24000, 44000)[two]
            out[two, one, 0, 1] = (1, 4000, 8000, 12000)[one]
            out[two, one, 1, 1] = 1
    rest = (1 << _WEIGHT_BITS) - out.sum(axis=-1)
    out[..., _ANY] = rest // 3
    out[..., 2] = rest - rest // 3
    return out.reshape(-1, 4)


#: A source that explains an id draws its weight towards all but this, which the others share.
_KEPT_BACK = 48


class _Blocks:
    """What has been seen in each of some blocks that are coded in step, and the ends of their ranges.

    Ids are known by rank: the order of their first places in the block. A rank's name is one more; 0 names none.
    Ranks and names are of the type of the slots, which is as small as the blocks' size allows.
    """

    def __init__(self, lanes: int, size: int, vocabulary: int, names: np.ndarray | None = None, version: int = 2):
        self.n, self.vocabulary = lanes, vocabulary
        self.kind = np.uint16 if 4 * size + 3 < 1 << 16 else np.int32
        self.lane = np.arange(lanes)
        slots_1, slots_2, self.growth, self.learn_every = _MODELS[version]
        self.mask_1, self.mask_2 = np.uint32(slots_1 - 1), np.uint32(slots_2 - 1)
        first = _first_weights()
        self.weights = np.tile(first.astype(np.int32), (lanes, 1))  # the four of a confidence side by side
        self.rows = self.weights.view(np.complex128).reshape(-1)  # the same memory, four weights as one value to move
        self.context_row, self.four = self.lane * len(first), self.lane * 4
        self.slots = np.zeros(lanes * (slots_1 + slots_2), self.kind)  # name * 4 + confidence; 0: nothing foreseen
        self.base = np.stack([self.lane * slots_2, lanes * slots_2 + self.lane * slots_1])
        self.slot_at, self.upper = np.empty((2, lanes), np.int64), np.empty((lanes, 4), np.int32)
        self.upper[:, _ANY] = 1 << _WEIGHT_BITS
        self.by_value = names is None
        self.names = np.zeros((size, lanes), self.kind) if names is None else names.astype(self.kind, copy=False)  # of the ids so far at least
        self.seen = np.zeros(lanes, self.kind)
        self.counts = np.zeros((lanes, size), np.int16 if size < 1 << 15 else np.int32)
        self.begin_bits, self.packed = (16, np.uint32) if size < 1 << 16 else (32, _U)
        self.prev1 = self.prev2 = np.zeros(lanes, np.uint32)
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.at, self.total, self.next_sums = 0, 0, 0
        self._sum_up()

    def _sum_up(self) -> None:
        """Counts of all ids seen so far and their sums. Until it is done again, later ids count once each."""
        width = int(self.seen.max()) if self.n else 0
        if width:
            own = self.names[self.total : self.at].T.astype(np.int64, order="C")  # block by block, so that a block's counts stay at hand
            own += (self.lane * width - 1)[:, None]
            self.counts[:, :width] += np.bincount(own.reshape(-1), minlength=self.n * width).reshape(self.n, width)
        self.known, self.total = self.seen.copy(), self.at  # each id counts, so all blocks have the same total
        counts = self.counts[:, :width]
        sums = np.empty((self.n, width + 1), self.packed)  # a rank's begin and count in one value
        sums[:, width] = self.total
        np.cumsum(counts, axis=1, dtype=self.packed, out=sums[:, :width])
        sums <<= self.packed(self.begin_bits)
        sums[:, :width] -= counts.astype(self.packed) * self.packed((1 << self.begin_bits) - 1)  # the end becomes the begin, with the count
        self.sums, self.sums_row = sums.reshape(-1), self.lane * (width + 1)
        if self.by_value:  # the rank at each place of the counts laid out one after another
            self.of_value = np.repeat(np.tile(np.arange(width, dtype=self.kind), self.n), counts.reshape(-1)) if width else np.zeros(1, self.kind)
            self.value_row = self.lane * self.total
        self.next_sums = max(self.at + 16, self.at * self.growth[0] // self.growth[1])

    def foresee(self) -> None:
        """The slots, the two foreseen names, their confidence and the weights of the sources."""
        if self.at >= self.next_sums:
            self._sum_up()
        hashed = self.prev2 * np.uint32(40503)
        hashed += self.prev1
        hashed *= np.uint32(2654435761)
        hashed >>= np.uint32(15)
        hashed &= self.mask_2
        at = self.slot_at
        at[0] = hashed
        at[1] = self.prev1 & self.mask_1
        at += self.base
        found = self.slots.take(at)
        self.sure = found & self.kind(3)
        found >>= self.kind(2)
        self.foreseen = found
        context = self.sure[0] << self.kind(2)
        context |= self.sure[1]
        context <<= self.kind(1)
        context |= found[0] == found[1]
        self.weight_at = self.context_row + context
        self.weight = w = self.rows.take(self.weight_at).view(np.int32).reshape(-1, 4)
        upper = self.upper
        upper[:, 0] = w[:, 0]
        np.add(w[:, 0], w[:, 1], out=upper[:, 1])
        np.add(upper[:, 1], w[:, 2], out=upper[:, 2])
        self.unit = self.range >> _U(_WEIGHT_BITS)

    def choose(self, source: np.ndarray) -> None:
        """The range shrinks to the weight of the source of each block."""
        self.chosen = self.four + source
        share = self.weight.reshape(-1).take(self.chosen)
        begin = self.upper.reshape(-1).take(self.chosen)
        begin -= share
        self.low += begin.astype(_U) * self.unit
        self.range = self.unit
        self.range *= share.astype(_U)

    def parts(self, counted: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Into how many parts each block's range is divided: all counts for order 0 (counted), the vocabulary for a new id, else one."""
        out = (self.seen - self.known).astype(_U)
        out += _U(self.total)
        out -= _U(1)
        out *= counted
        out += _U(1)
        out += new * _U(self.vocabulary - 1)
        return out

    def narrow(self, counted: np.ndarray, rank: np.ndarray, begin: np.ndarray, unit: np.ndarray) -> None:
        """Ranges shrink to some of their parts, each of one unit: for order 0 (counted) those of a rank, else one from begin on."""
        known = np.minimum(rank, self.known)  # an id not counted yet lies behind all that are
        rank = rank - known
        known *= counted
        found = self.sums.take(self.sums_row + known)
        share = found & self.packed((1 << self.begin_bits) - 1)
        found >>= self.packed(self.begin_bits)
        found += rank.astype(self.packed)
        found *= counted
        share *= counted
        begin += found
        begin *= unit
        self.low += begin
        self.range = np.maximum(share, self.packed(1)) * unit

    def learn(self, name: np.ndarray) -> None:
        if self.at % self.learn_every == 0:
            self._weigh()
        # Foreseen ids: a doubted one is replaced, a wrong one's confidence falls to 1, a right one's rises, to 3 at most.
        sure, one = self.sure, self.kind(1)
        held = name - self.foreseen  # these types wrap round
        held *= sure <= one
        held += self.foreseen
        held <<= self.kind(2)
        np.minimum(sure, self.kind(2), out=sure)
        sure *= self.foreseen == name
        sure += one
        held |= sure
        self.slots[self.slot_at] = held
        self.prev2, self.prev1 = self.prev1, name.astype(np.uint32)
        self.at += 1

    def _weigh(self) -> None:
        """Weights: towards the source that explained the id; they still add up to 2**16, none falls below 1."""
        w = self.weight
        part = w - _KEPT_BACK // 4
        part >>= _LEARN
        w -= part
        left = (1 << _WEIGHT_BITS) - w[:, 0]
        for i in (1, 2, 3):
            left -= w[:, i]
        w.reshape(-1)[self.chosen] += left
        self.rows[self.weight_at] = w.view(np.complex128).reshape(-1)

    def settled(self, who: np.ndarray | None = None) -> np.ndarray:
        """Whether blocks have to let 16 bits go; their ranges, if too small, are cut to end where the next part begins."""
        low, reach = (self.low, self.range) if who is None else (self.low.take(who), self.range.take(who))
        end = low + reach
        end ^= low
        go, small = end < _SETTLED, reach < _FLOOR
        late = small > go
        if late.any():
            cut = np.flatnonzero(late)
            self.range[cut if who is None else who[cut]] = (~low[cut] + _U(1)) & (_FLOOR - _U(1))
        go |= small
        return go

    def shift(self, go: np.ndarray) -> np.ndarray:
        """All blocks of which go holds let 16 bits go; by how many each has moved."""
        by = go.astype(_U)
        by <<= _U(4)
        self.low <<= by
        self.range <<= by
        return by

    def again(self, go: np.ndarray) -> np.ndarray:
        """Of the blocks that have let 16 bits go: which have to once more. With a range of 2**48 the first 16 bits are open."""
        who = np.flatnonzero(go & (self.range < _SETTLED))
        return who[self.settled(who)]

    def shift_few(self, who: np.ndarray) -> None:
        self.low[who] <<= _U(16)
        self.range[who] <<= _U(16)


def _names(ids: np.ndarray) -> np.ndarray:
    """The ranks' names step by step."""
    lanes, size = ids.shape
    out = np.empty((size, lanes), np.uint16 if size < 1 << 16 else np.int32)
    small = ids.max(initial=0) < 1 << 16
    for lo in range(0, lanes, _AT_ONCE):
        rows = ids[lo : lo + _AT_ONCE]
        parts = [_looked_up_ranks(rows[i : i + _LOOKED_UP]) for i in range(0, len(rows), _LOOKED_UP)] if small else [_ranks(rows)]
        part = np.concatenate(parts).astype(out.dtype)
        part += 1
        out[:, lo : lo + _AT_ONCE] = np.ascontiguousarray(part.T)  # rows far apart would push each other out of the cache
    return out


def _looked_up_ranks(ids: np.ndarray) -> np.ndarray:
    """As _ranks, of ids below 2**16: a table of all ids for each row tells the first place, and by it the rank."""
    lanes, size = ids.shape
    keys = (ids + (np.arange(lanes) << 16)[:, None]).reshape(-1)
    places = np.arange(lanes * size, dtype=np.int32)
    table = np.empty(lanes << 16, np.int32)  # only what is written is read
    table[keys[::-1].copy()] = places[::-1].copy()  # of equal ids the last written is the first of the row
    first = table.take(keys)
    if (first > places).any():  # numpy does not promise the order of writing
        return _ranks(ids)
    nth = np.cumsum((first == places).reshape(lanes, size), axis=1, dtype=np.int32)
    nth -= 1
    return nth.reshape(-1).take(first).reshape(lanes, size)


def _ranks(ids: np.ndarray) -> np.ndarray:
    """For each row its ids by order of their first places in it."""
    lanes, size = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    order += np.arange(lanes)[:, None] * size
    order = order.reshape(-1)
    held = ids.reshape(-1)[order]
    head = np.ones(len(held), bool)
    head[1:] = held[1:] != held[:-1]
    head[::size] = True
    first = order[np.flatnonzero(head)]  # the first place of each id of each row
    group = np.cumsum(head) - 1
    is_first = np.zeros(len(held), np.int64)
    is_first[first] = 1
    nth = is_first.reshape(lanes, size).cumsum(axis=1).reshape(-1) - 1
    out = np.empty(len(held), np.int64)
    out[order] = nth[first][group]
    return out.reshape(lanes, size)


def encode_blocks(ids: np.ndarray, vocabulary: int, version: int = 2) -> list[bytes]:
    """A range-coded block for each row of ids, all below vocabulary."""
    lanes, size = ids.shape
    m = _Blocks(lanes, size, vocabulary, _names(ids), version)
    flat, row = np.ascontiguousarray(ids, np.uint32).reshape(-1), m.lane * size
    room = 4 * _STEPS + 8  # 16-bit parts that a block may let go in some steps
    held = np.empty(lanes * room, np.uint16)
    begins, out = m.lane * room, []
    at = begins.copy()

    def let_go() -> None:
        data = held.astype("<u2", copy=False).tobytes()
        out.append([data[a:b] for a, b in zip((2 * begins).tolist(), (2 * at).tolist(), strict=True)])
        at[:] = begins

    for t in range(size):
        name = m.names[t]
        m.foresee()
        right, new = m.foreseen == name, name > m.seen
        source = new.view(np.int8) + np.int8(1)  # 0 where order 2 is right, 1 where only order 1 is, 3 for a new id, else 2
        source *= ~right[1]
        source += np.int8(1)
        source *= ~right[0]
        m.choose(source)
        counted, begin = source == 2, np.zeros(lanes, _U)
        who = np.flatnonzero(new)
        begin[who] = flat.take(row.take(who) + t)
        m.narrow(counted, name - m.kind(1), begin, m.range // m.parts(counted, new))
        m.seen += new
        m.learn(name)
        go = m.settled()
        held[at] = m.low >> _U(48)  # where it stays, the next is written over it
        at += go
        m.shift(go)
        who = m.again(go)
        while len(who):
            held[at.take(who)] = m.low.take(who) >> _U(48)
            at[who] += 1
            m.shift_few(who)
            who = who[m.settled(who)]
        if t % _STEPS == _STEPS - 1:
            let_go()
    # The range holds 2**40 values at least, so one whose lower half is zero.
    last = (m.low >> _U(32)) + _U(1)
    held[at], held[at + 1] = last >> _U(16), last & _U(0xFFFF)
    at += 2
    let_go()
    return [b"".join(parts) for parts in zip(*out, strict=True)]


def decode_blocks(blocks: list[bytes], size: int, vocabulary: int, version: int = 2) -> np.ndarray:
    """The ids of blocks that encode_blocks has made, a row for each."""
    lanes = len(blocks)
    m = _Blocks(lanes, size, vocabulary, version=version)
    lengths = np.array([len(b) // 2 for b in blocks], np.int64)
    starts = np.cumsum(lengths + 8) - (lengths + 8)
    words = np.zeros(int((lengths + 8).sum()) + 8, np.uint16)
    for b, s in zip(blocks, starts.tolist(), strict=True):
        words[s : s + len(b) // 2] = np.frombuffer(b, "<u2")
    at, most = starts.copy(), starts + lengths + 4
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _U(16) | words[at]
        at += 1
    ids_of = np.zeros((lanes, size), np.uint32)  # by rank

    for t in range(size):
        m.foresee()
        value = ((code - m.low) // m.unit).astype(np.int32)
        source = (value >= m.upper[:, 0]).view(np.int8) + (value >= m.upper[:, 1])
        source += value >= m.upper[:, 2]
        m.choose(source)
        name = m.foreseen - m.seen  # these types wrap round
        name[0] *= source == 0
        name[1] *= source == 1
        name = name[0] + name[1]
        name += m.seen
        counted, new = source == 2, source == _ANY
        parts = m.parts(counted, new)
        unit = m.range // parts
        parts -= _U(1)
        value = code - m.low
        value //= unit
        np.minimum(value, parts, out=value)
        place = value.view(np.int64)
        later = place - m.total
        rank = np.where(later < 0, m.of_value.take(m.value_row + place, mode="clip"), later + m.known).astype(m.kind)
        name += (rank + m.kind(1) - name) * counted
        who = np.flatnonzero(new)
        ids_of[who, m.seen.take(who)] = value.take(who)
        m.narrow(counted, rank, value * new, unit)
        m.seen += new
        name += new
        if name.min() < 1 or (name > m.seen).any():
            raise ValueError("a damaged block")
        m.names[t] = name
        m.learn(name)
        by = m.shift(go := m.settled())
        code <<= by
        code |= words.take(at) * go
        at += go
        who = m.again(go)
        while len(who):
            code[who] = code.take(who) << _U(16) | words.take(np.minimum(at.take(who), most.take(who)))
            at[who] += 1
            m.shift_few(who)
            who = who[m.settled(who)]
        np.minimum(at, most, out=at)
    for lo in range(0, lanes, _AT_ONCE):
        part = np.ascontiguousarray(m.names[:, lo : lo + _AT_ONCE]).T.astype(np.int64, order="C")
        part += (m.lane[lo : lo + _AT_ONCE] * size - 1)[:, None]
        ids_of[lo : lo + _AT_ONCE] = ids_of.reshape(-1).take(part)
    return ids_of


def block_size(ids: int) -> int:
    return min(max(-(-ids // LANES), LEAST_BLOCK), MOST_BLOCK)


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A file: head, documents (id and number of ids), directory of blocks (length, CRC-32 of their ids), blocks.

    The last block is filled up with its last id.
    """
    size = block_size(len(ids))
    lanes = -(-len(ids) // size)
    full = np.empty(lanes * size, "<u4")
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(lanes, size)
    if len(ids) and int(full.max()) >= vocabulary:
        raise ValueError("an id beyond the vocabulary")
    step = max(1, SHARD_IDS // size)  # a document longer than a shard by parts
    blocks = [b for lo in range(0, lanes, step) for b in encode_blocks(full[lo : lo + step], vocabulary, _VERSION)]
    directory = np.array([(len(b), zlib.crc32(x)) for b, x in zip(blocks, full, strict=True)], "<u4").reshape(-1, 2)
    docs = np.array([_NULL_DOC if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes()
    return b"".join([_HEAD.pack(_MAGIC, _VERSION, size, vocabulary, len(doc_ids), len(ids), lanes), docs, directory.tobytes(), *blocks])


class ShardReader:
    """Reads a shard by its directory; any blocks can be decoded without the others. Damage raises ValueError."""

    def __init__(self, data: bytes):
        magic, self.version, self.size, self.vocabulary, docs, self.n_ids, lanes = _HEAD.unpack_from(data)
        if magic != _MAGIC or self.version not in _MODELS:
            raise ValueError("not a shard of ids")
        at = _HEAD.size
        doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
        self.doc_ids = [None if d == _NULL_DOC else d for d in doc_ids]
        self.counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        directory = np.frombuffer(data, "<u4", 2 * lanes, at + 16 * docs).reshape(-1, 2).astype(np.int64)
        ends = at + 16 * docs + 8 * lanes + np.cumsum(directory[:, 0])
        self.data, self.spans, self.sums = data, list(zip((ends - directory[:, 0]).tolist(), ends.tolist(), strict=True)), directory[:, 1]

    def blocks(self, which: list[int]) -> np.ndarray:
        """The ids of some blocks, a row for each, checked against their sums."""
        got = decode_blocks([self.data[a:b] for a, b in (self.spans[i] for i in which)], self.size, self.vocabulary, self.version)
        for i, row in zip(which, got, strict=True):
            if zlib.crc32(row.astype("<u4").tobytes()) != self.sums[i]:
                raise ValueError(f"block {i} does not match its sum")
        return got

    def ids(self) -> np.ndarray:
        step = max(1, SHARD_IDS // self.size)
        parts = [self.blocks(list(range(lo, min(lo + step, len(self.spans))))).astype("<u4").reshape(-1) for lo in range(0, len(self.spans), step)]
        return np.concatenate([*parts, np.zeros(0, "<u4")])[: self.n_ids]

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document; only the blocks that hold it are decoded."""
        end = int(self.counts[: n + 1].sum())
        start = end - int(self.counts[n])
        first, last = start // self.size, max(start, end - 1) // self.size
        if start == end:
            return np.zeros(0, np.int64)
        return self.blocks(list(range(first, last + 1))).reshape(-1)[start - first * self.size : end - first * self.size]


_SHARD = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards (part, nth, before, n_ids, data) of the ids of all texts, each followed by end_id, by ascending doc_id.

    data is a file's content; parts and in them nth give the order of the files, before is the number of ids of the same
    part ahead. A null doc_id comes first; rows of one doc_id are ordered by their texts' hash, equal rows by place, so
    a hot id is spread too. Null and empty texts are the end id alone. A text longer than shard_ids has a shard of its
    own. Other columns are not read; an empty table gives no shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        encode, vocabulary = _encoder(tokenizer), Tokenizer.from_file(tokenizer).get_vocab_size()
        vocabulary = max(vocabulary, end_id + 1)
        part, nth, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, texts = [], [], []
        end = np.array([end_id], "<u4")

        def shard() -> pa.RecordBatch:
            whole = np.concatenate(texts)
            texts.clear()
            common.release()  # what tokenizing took, before the coder takes its own
            data = write_shard(ids, counts, whole, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, nth, before, held, data), _SHARD.types, strict=True)], schema=_SHARD)

        for batch in common.chunks(batches, "text", ENCODED_BYTES):
            every, sizes = encode.rows(batch.column("text"))
            for key, own in zip(batch.column("id").to_pylist(), np.split(every, np.cumsum(sizes)[:-1]), strict=True):
                if held and held + len(own) >= shard_ids:
                    yield shard()
                    nth, before, held = nth + 1, before + held, 0
                    ids, counts, texts = [], [], []
                ids.append(key)
                counts.append(len(own) + 1)
                texts += [own, end]
                held += len(own) + 1
        if held:
            yield shard()

    return rows.mapInArrow(shards, "part int, nth int, before long, n_ids long, data binary")


def read_token_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each document of shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    shards is read twice, so pass a table. Fails on a damaged shard. The sums of the parts, as many as the writer had
    tasks, are added up in one task and broadcast.
    """
    fields = [("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                reader = ShardReader(data.as_py())
                ids, ends = reader.ids().astype("<u4"), np.cumsum(reader.counts)
                starts = ends - reader.counts
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array([part] * len(sums), pa.int32()), pa.array(before + starts), pa.array(reader.doc_ids, pa.int64()), pa.array(reader.counts), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(common.lists(ids.astype(np.int32), reader.counts, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, schema=schema)
        common.release()

    plain = shards.select("part", "before", "data").mapInArrow(rows, "part int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    found = plain.join(F.broadcast(parts), "part")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_files(shards: DataFrame, folder: str) -> None:
    """Put each shard into a file <part>-<nth>.ids below folder, a path or URI that all executors can write to; names sort in doc_id order."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        for batch in batches:
            for part, nth, data in zip(batch.column("part").to_pylist(), batch.column("nth").to_pylist(), batch.column("data"), strict=True):
                with store.open_output_stream(f"{base}/{part:06d}-{nth:06d}.ids", compression=None) as out:  # a repeated task writes the same bytes
                    out.write(data.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("part")], ["part"])

    shards.select("part", "nth", "data").mapInArrow(put, "part int").write.format("noop").mode("overwrite").save()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = common.stage(write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")), "shards", "none")
    return read_token_shards(shards)
