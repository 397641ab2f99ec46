"""Rows packed into binary blobs by bucket, for shuffles of many tiny fixed-width rows.

A map task sorts its rows by bucket and sends one blob for each bucket it has rows for; a reduce task takes one bucket at
a time. The number of buckets follows the size of the input, so a bucket, and with it what a task holds in memory, keeps
its size as the input grows; with very many buckets a blob shrinks to a single row and costs what a plain row costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import trim

#: Packed bytes that one bucket should hold.
BUCKET_BYTES = 8 << 20
SCHEMA = "bucket int, kind int, rows binary"


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def pack(bucket: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """One (bucket, kind, rows) for each bucket among ``bucket``; ``rows`` is an array of bytes or records, a row each."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], np.ascontiguousarray(rows[order])
    starts = heads(bucket)
    ends = np.append(starts, len(bucket))[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
        ["bucket", "kind", "rows"],
    )


def reduce_buckets(packed: DataFrame, buckets: int, run: Callable[[int, dict[int, bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run(bucket, {kind: bytes})`` for every bucket, one at a time in a task."""

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for bucket, kind, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    if held:
                        yield from run(now, {k: b"".join(v) for k, v in held.items()})
                    now, held = bucket, {}
                held.setdefault(kind, []).append(rows.as_py())
        if held:
            yield from run(now, {k: b"".join(v) for k, v in held.items()})
        now, held = None, {}
        trim()

    to = F.col("bucket")
    if buckets <= _SPREAD:
        # one bucket to a partition: their numbers are stood for by integers that Spark's hash sends to different ones
        to = F.element_at(F.array(*map(F.lit, _representatives(buckets))), to + 1)
    return packed.repartition(buckets, to).sortWithinPartitions("bucket").mapInArrow(tasks, schema)


#: Buckets up to which they are spread evenly; with more of them, several to a partition, hashing evens out by itself.
_SPREAD = 4096


def _spark_hash(x: int) -> int:
    """Spark's hash of an integer column: Murmur3 (32 bits) with seed 42."""
    m = (1 << 32) - 1
    turn = lambda v, n: ((v << n) | (v >> (32 - n))) & m
    k = turn(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (turn(42 ^ k, 13) * 5 + 0xE6546B64 & m) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _representatives(buckets: int) -> list[int]:
    """For each bucket the least integer that is hashed to the partition of its number."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < buckets:
        found.setdefault(_spark_hash(x) % buckets, x)
        x += 1
    return [found[b] for b in range(buckets)]


def text_bytes(df: DataFrame) -> int:
    """About the bytes that the texts (column text) of ``df`` take in files.

    For a plain scan Spark knows them from the files. Its estimates for joins, and its default for frames that don't come
    from files, can be off by orders of magnitude, so there the texts are measured, and counted by half for compression.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if _plain(plan):
        return int(plan.stats().sizeInBytes())
    return int(df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 2


def _plain(node) -> bool:
    """Whether a plan is a scan of files with projections and filters only."""
    kind = node.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return "HadoopFsRelation" in node.relation().getClass().getSimpleName()
    return kind in ("Project", "Filter") and _plain(node.children().apply(0))
