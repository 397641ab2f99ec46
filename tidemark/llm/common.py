"""Shared pieces of the corpus operators: written intermediates and array kernels over Arrow text.

The kernels work on the UTF-8 bytes of a whole piece of a batch at once. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; those are ASCII, so a multi-byte character is never cut. Hashes are 64 bit: a prefix-sum polynomial
over the bytes (or over word hashes), finished by a bit mixer.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# ---------------------------------------------------------------------------------------------------- written tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the cluster's machines share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return str(found)


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back: later jobs start from the files, whichever executor dies.

    A lazy result may read the table as long as the driver lives, so it goes when the driver ends.
    """
    table, path = _write(df)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(path)
    return table


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that go when the block ends; what is returned from the block must not read them any more.

    The end of the block also lets Spark drop the shuffle files of the frames that went out of use in it, which it does when
    the driver's garbage is collected.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        table, path = _write(df)
        self.paths.append(path)
        return table

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for x in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Collects garbage, so that Spark's cleaner drops shuffle files that nothing refers to, and gives free memory back."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives back what Arrow and the C library keep of freed memory: a worker outlives its task, and so would that."""
    pa.default_memory_pool().release_unused()
    # other C libraries than glibc have no such call
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


#: Rows from which a key can be hot, how many of the most frequent keys are, and in how many parts the rows of each are dealt.
LEAST_HOT, HOT_KEYS, PARTS = 1000, 1024, 64


def hot_keys(left: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the most frequent keys of ``left``, ``HOT_KEYS`` at most; any other has less than one in so many of the rows."""
    often = left.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_HOT)
    return [r[0] for r in often.orderBy(F.desc("_n"), "_h").limit(HOT_KEYS).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "left", hot: tuple[list[str], list[int]] | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, the rows of hot keys (nulls too) dealt in parts by the columns ``by`` of ``left``.

    Only the hot keys' rows of ``right`` are repeated, once a part. ``left`` is read twice, so it should be a table; or ``hot`` says
    which of the keys tell, and the hashes of those that are hot.
    """
    told, found = hot or (keys, hot_keys(left, keys))
    if not found:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*told).isin(found)
    part = F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_part", part).join(right.withColumn("_part", F.explode(parts)), [*keys, "_part"], how).drop("_part")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ------------------------------------------------------------------------------------------------------ Arrow batches


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    trim()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and a mask of those that are null."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def table(**columns: np.ndarray | pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


# -------------------------------------------------------------------------------------------------------- text kernels

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words where only ASCII letters and digits, and all that isn't ASCII, make words.
PUNCTUATION = np.arange(256) < 0x80
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end byte of each word, and the index of each row's first word (one more for the end)."""
    ink = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), start, end, bounds


# ------------------------------------------------------------------------------------------------------------- hashing

#: Odd bases of the two independent polynomials, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[which, inverse] = have
    return have[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair; equal spans have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * _powers(which, len(values), False), out=total[1:])
    out = total[end]
    out -= total[start]
    out *= _powers(which, len(values) + 1, True)[start]
    out += (end - start).astype(_U) * _U(0x632BE59BD9B4E019)
    return mix(out)


def _bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def distinct_sorted(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) pairs in order; neither is negative.

    One sort of 64-bit numbers is ten times as fast as a sort by two columns, so group and value share a number where they
    fit, or else the group and the value's high bits. Should different values then share a number, two columns decide.
    """
    high = max(1, _bits(group))
    if high + _bits(value) <= 64:
        low = _U(64 - high)
        both = np.sort((group.astype(_U) << low) | value.astype(_U))
        both = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
        return (both >> low).astype(np.int64), (both & ((_U(1) << low) - _U(1))).astype(value.dtype)
    both = (group.astype(_U) << _U(64 - high)) | (value >> _U(high))
    order = np.argsort(both)
    both, sorted_ = both[order], value[order]
    again = both[1:] == both[:-1]
    if (again & (sorted_[1:] != sorted_[:-1])).any():
        order = np.lexsort((value, group))
        sorted_ = value[order]
        again = (group[order][1:] == group[order][:-1]) & (sorted_[1:] == sorted_[:-1])
    new = np.concatenate((np.ones(min(1, len(order)), bool), ~again))
    return group[order][new], sorted_[new]


def stable_order(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by (group, rank) that leaves equals as they stand; neither is negative."""
    index = max(1, len(group) - 1).bit_length()
    low = _bits(rank)
    if _bits(group) + low + index > 63:
        return np.lexsort((rank, group))
    both = np.sort((group.astype(_U) << _U(low + index)) | (rank.astype(_U) << _U(index)) | np.arange(len(group), dtype=_U))
    return (both & _U((1 << index) - 1)).astype(np.int64)
