"""A Python data source for stores: ``spark.read.format("tidemark").option("path", ...)``.

It gives the versions of a store (k, seq, deleted, tag and the variants' fields) from the runs that can hold keys under the
option ``prefix`` and from the changelog segments that aren't in a run yet. Each is one partition or, where it is large, as many
as its rows and bytes ask for, so what a task has to hold doesn't grow with the store. Resolving them is left to
``operators.resolve``, where Catalyst can push filters below it; inside Spark ``KvStore.state`` is the better way in, as it reads
Parquet without Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.keys import succ

SCHEMA = "k string, seq bigint, deleted boolean, tag tinyint, s string, i bigint, u decimal(20,0), d double, b boolean, bin binary, j string, expires_at bigint"
_FIELDS = ("tag", "s", "i", "u", "d", "b", "bin", "j")
#: What one task reads at the most: rows, and bytes of Parquet before compression.
ROWS, BYTES = 1_000_000, 64 << 20
#: Rows that are sent to Spark at once.
BATCH = 10_000
#: Footers that are read at once when partitions are planned.
FOOTERS = 16


@dataclass
class RunPartition(InputPartition):
    #: (file, row group, first row, rows)
    parts: list[tuple[str, int, int, int]]
    #: What is added to a row's seq: a segment has ordinals.
    base: int


class KvDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return KvReader(self.options)


class KvReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.prefix, self.version = options["path"].rstrip("/"), options.get("prefix", ""), options.get("version")

    def _files(self) -> tuple[fs.FileSystem, str]:
        """Arrow's file system for the path. Hadoop's names of S3 (s3a, s3n) are Arrow's s3."""
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        scheme, _, rest = self.path.partition(":")
        return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")

    def partitions(self) -> list[RunPartition]:
        files, root = self._files()
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True)) if x.base_name.startswith("v") and x.base_name.endswith(".json"))
        if not names:
            return []
        name = f"v{int(self.version):012d}.json" if self.version else names[-1]
        manifest = json.loads(files.open_input_stream(f"{root}/manifest/{name}").read())
        high = succ(self.prefix)
        folders = [(r["path"], 0) for r in manifest["runs"] if r["largest_key"] >= self.prefix and (not high or r["smallest_key"] < high)]
        folders += [(folder, int(base)) for base, _, folder in (s.partition(":") for s in manifest["segments"])]
        with ThreadPoolExecutor(FOOTERS) as pool:
            # a folder that is gone is an error here, not less to read
            listed = list(pool.map(lambda x: files.get_file_info(fs.FileSelector(f"{root}/{x[0]}")), folders))
            names = [sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", "."))) for found in listed]
            parts = pool.map(lambda name: self._parts(files, name), [name for each in names for name in each])
            return [RunPartition(task, base) for (_, base), each in zip(folders, names, strict=True) for task in _tasks([part for _ in each for part in next(parts)])]

    def _parts(self, files: fs.FileSystem, name: str) -> list[tuple[tuple[str, int, int, int], float]]:
        """The file's row groups that can hold keys under the prefix, in pieces that a task may have, each with its share of one."""
        footer, out = pq.read_metadata(name, filesystem=files), []
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            if not group.num_rows or not self._meets(group):
                continue
            size = max(group.num_rows / ROWS, group.total_byte_size / BYTES)
            step = math.ceil(group.num_rows / math.ceil(size))
            for first in range(0, group.num_rows, step):
                rows = min(step, group.num_rows - first)
                out.append(((name, g, first, rows), size * rows / group.num_rows))
        return out

    def _meets(self, group: pq.RowGroupMetaData) -> bool:
        k = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "k")
        if not k.is_stats_set or not k.statistics.has_min_max:
            return True
        high = succ(self.prefix)
        return k.statistics.max >= self.prefix and (not high or k.statistics.min < high)

    def read(self, partition: RunPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = self._files()
        high = succ(self.prefix)
        kinds = {"tag": pa.int8(), "s": pa.string(), "i": pa.int64(), "u": pa.decimal128(20, 0), "d": pa.float64(), "b": pa.bool_(), "bin": pa.binary(), "j": pa.string()}
        for batch in _batches(files, partition.parts):
            k = batch.column("k")
            wanted = pc.greater_equal(k, self.prefix)
            batch = batch.filter(pc.and_(wanted, pc.less(k, high)) if high else wanted)
            v = batch.column("v")
            inner = [pc.struct_field(v, name).cast(kinds[name]) for name in _FIELDS]
            columns = [batch.column("k"), pc.add(batch.column("seq"), partition.base), batch.column("deleted"), *inner, batch.column("expires_at")]
            yield pa.RecordBatch.from_arrays(columns, ["k", "seq", "deleted", *_FIELDS, "expires_at"])


def _tasks(parts: list[tuple[tuple[str, int, int, int], float]]) -> Iterator[list[tuple[str, int, int, int]]]:
    """Parts that follow each other, as many together as one task may have."""
    task, full = [], 0.0
    for part, share in parts:
        if task and full + share > 1:
            yield task
            task, full = [], 0.0
        task.append(part)
        full += share
    if task:
        yield task


def _batches(files: fs.FileSystem, parts: list[tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The parts' rows. Only whole row groups can be sought, so rows before a part are decoded and left out."""
    for name, of_file in groupby(parts, key=lambda part: part[0]):
        with pq.ParquetFile(name, filesystem=files) as rows:
            for _, group, first, count in of_file:
                at = 0
                for batch in rows.iter_batches(BATCH, [group], ["k", "seq", "deleted", "v", "expires_at"], use_threads=False):
                    low, high = max(first - at, 0), min(first + count - at, batch.num_rows)
                    if low < high:
                        yield batch.slice(low, high - low)
                    at += batch.num_rows
                    if at >= first + count:
                        break


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KvDataSource)
