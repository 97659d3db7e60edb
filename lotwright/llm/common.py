"""Helpers of the llm operators: scratch tables in the shared folder, Arrow batches as byte arrays, hashes.

Scratch tables are Parquet below the folder that spark.checkpoint.dir names, so every executor and a restarted
job can read them; nothing is kept in an executor's own folder.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker; numpy needs some 60 bytes for each byte of text.
CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session that names none, as in tests, gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lotwright-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lotwright/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to a scratch table and read it again: cuts the lineage and is read by any later job."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned_bytes(df: DataFrame) -> int:
    """The size of what df reads as Spark's statistics have it; 0 where they do not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def drop(*frames: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give back what Arrow's pool and malloc hold unused: Spark keeps Python workers, and their memory counts beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about limit bytes; a longer text stands alone. After the last the worker's unused memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and each row's offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: White space that separates words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (rows + 1 values)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = solid[heads]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_U = np.uint64
#: Random values for the bytes.
BYTE = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
#: The Mersenne prime that span hashes are taken modulo; products of two residues fit 64 bits.
_PRIME = (1 << 31) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A number equal to x modulo the prime, below 2**32 for x below 2**62, in place."""
    high = x >> _U(31)
    x &= _U(_PRIME)
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place."""
    x = _fold(_fold(_fold(x)))
    x[x == _U(_PRIME)] = 0
    return x


def _series(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i below n, by doubling."""
    out = np.ones(n, _U)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _residue(out[:more] * _U(step))
        have, step = have + more, step * step % _PRIME
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = _powers[base] = (_series(base, size), _series(pow(base, -1, _PRIME), size))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def bases(seed: int) -> list[int]:
    """The two bases that a seed draws."""
    return np.random.RandomState(seed).randint(1 << 20, _PRIME, 2).tolist()


class Spans:
    """Hashes of any spans of a sequence of 64-bit values: two polynomials modulo a prime at drawn bases, by prefix sums.

    Two different spans of n values agree in both with a probability of some (n / 2**31)**2 over the bases, whatever the
    values are; a power of two as modulus has no such bound. Other seeds draw other bases.
    """

    def __init__(self, values: np.ndarray, seed: int = 1):
        self.parts = []
        for base, part in zip(bases(seed), (values & _U(_PRIME), values >> _U(33)), strict=True):
            up, down = powers(base, len(values) + 1)
            sums = np.zeros(len(values) + 1, _U)
            part *= up[: len(values)]
            np.cumsum(_fold(part), out=sums[1:])  # terms below 2**32: 2**31 of them fit
            self.parts.append((sums, down))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (_residue(_fold(_fold(sums[ends] - sums[starts])) * down[starts]) for sums, down in self.parts)
        return mix((a << _U(31) | b) + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return Spans(BYTE[data], seed)(starts, ends)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: counts[i] of the values to row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.view(np.int64) if values.dtype == _U else values, kind))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of df has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, which the caller is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


#: Keys with more than this share of all counted rows are hot; there are at most as many of them as it goes into 1.
HOT_SHARE = 1e-4


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among keys (columns on, and n: in how many rows each stands), a hot key's rows dealt to many tasks.

    Hot keys are few by arithmetic, so they can be broadcast to tell which rows are to be salted.
    """
    salts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.where(F.col("n") > max(1000, total * HOT_SHARE)).select(*on).withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int").alias("_salt")
    salted = rows.join(F.broadcast(hot), on, "left").select(*rows.columns, salt)
    spread = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    wanted = keys.select(*on).join(F.broadcast(hot), on, "left").select(*on, spread)
    return salted.join(wanted, [*on, "_salt"], "left_semi").drop("_salt")


#: Rows of a hot key that one task of dealt_join is given, where HOT_SHARE of all rows is less.
FEW = 256


def dealt_join(rows: DataFrame, once: DataFrame, on: str, how: str = "inner", counted: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """rows joined with once, which holds a key at most one time, a hot key's rows dealt to many tasks.

    counted has the same keys as rows as often and is cheaper to read, if given. Rows are dealt by their columns by, which
    should tell rows of one key apart. A hot key's row of once is repeated for each of its tasks, altogether at most
    2 / HOT_SHARE times. Columns and their order are as of a plain join.
    """
    salt, salts = fresh(rows.select(*rows.columns, *[F.lit(0).alias(c) for c in once.columns if c not in rows.columns]), "_salt", "_salts")
    keys = (rows if counted is None else counted).groupBy(on).agg(F.count(F.lit(1)).alias(salts))
    keys = stage(keys.where(F.col(salts) > FEW), "hot")
    total = (rows if counted is None else counted).count()
    least = max(FEW, total * HOT_SHARE)
    hot = F.broadcast(keys.where(F.col(salts) > least).withColumn(salts, F.ceil(F.col(salts) / least).cast("int")))
    nth = F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(0), *(rows.columns if by is None else by)), F.col(salts))).cast("int").alias(salt)
    copies = F.when(F.col(salts).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(salts) - 1))
    salted = rows.join(hot, on, "left").select(*rows.columns, nth)
    spread = once.join(hot, on, "left").select(*once.columns, F.explode(copies).alias(salt))
    return salted.join(spread, [on, salt], how).select(on, *[c for c in rows.columns if c != on], *[c for c in once.columns if c != on])
