"""A key-value store: changelog segments and sorted Parquet runs under one folder, read as lazy DataFrames.

Writes from the driver are buffered and become one changelog segment at a time; data frames are appended as they are. A
flush turns the changelog into a sorted run and commits it; compaction merges runs. Readers work on one manifest version and
never see a half-made change. A file that a manifest names and that is gone fails the query.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config
from tidemark.errors import ColumnFamilyNotFound, CommitConflict, InvalidKey, InvalidValue, StorageError, Unsupported
from tidemark.functions.keys import CF_SEPARATOR, DEFAULT_CF, cf_key, run_filename, succ
from tidemark.functions.values import NULL, VALUE_TYPE, decode, encode, serialized_size
from tidemark.operators import adaptive, compaction, reads, stats
from tidemark.operators.resolve import newest, visible_at
from tidemark.sources.files import Files
from tidemark.sources.manifest import Manifest, Manifests, Run

#: How often a change is made again because the manifest has moved on under it.
TRIES = 10
#: Compactions that a manifest lists before they go to the history folder.
LISTED = 100


class _Stale(Exception):
    """What a change was based on is no longer so."""


ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("v", VALUE_TYPE), T.StructField("expires_at", T.LongType())])


class KvStore:
    """``KvStore.open(spark, path)``; every read method returns a DataFrame or, for single keys, a Python value."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), clock=time.time) -> None:
        self.spark, self.config, self.clock = spark, config.validate(), clock
        self.files = Files(spark, path)
        self.manifests = Manifests(self.files)
        self._pending: list[tuple[str, bool, tuple | None, int | None]] = []
        self._bulk = False
        self._workloads: list[dict] = []
        self._performance: list[dict] = []

    open = classmethod(lambda cls, spark, path, config=Config(), clock=time.time: cls(spark, path, config, clock))

    # ------------------------------------------------------------------------------------------------------- writing

    def put(self, key: str, value: Any) -> None:
        """Blind overwrite. None is a delete: there is no storable null."""
        self._write(key, value, None)

    def put_with_ttl(self, key: str, value: Any, seconds: int) -> None:
        self._write(key, value, int(self.clock()) + int(seconds))

    def put_durable(self, key: str, value: Any) -> None:
        self.put(key, value)
        self.sync()

    def delete(self, key: str) -> None:
        self._write(key, None, None)

    def batch_put(self, items: Iterable[tuple[str, Any]]) -> None:
        """In order, so the last of equal keys wins; all of it or nothing, as one changelog segment with what is pending."""
        items = list(items)
        if len(items) > self.config.max_batch_size:
            raise InvalidValue(f"batch of {len(items)} exceeds maximum {self.config.max_batch_size}")
        rows = []
        for key, value in items:
            self._check(key)
            rows.append(self._row(key, value, None))
        if self._pending or rows:
            self._append_rows([*self._pending, *rows])
            self._pending = []

    def batch_delete(self, keys: Iterable[str]) -> None:
        self.batch_put((k, None) for k in keys)

    def _check(self, key: str) -> None:
        if not key:
            raise InvalidKey("key cannot be empty")

    @staticmethod
    def _row(key: str, value: Any, expires: int | None) -> tuple[str, bool, tuple | None, int | None]:
        row = encode(value)
        gone = row[0] == NULL
        return key, gone, None if gone else row, None if gone else expires

    def _write(self, key: str, value: Any, expires: int | None) -> None:
        self._check(key)
        self._pending.append(self._row(key, value, expires))
        if len(self._pending) >= self.config.flush_rows:
            self.sync() if self._bulk else self.flush()

    def set_bulk_import(self, enabled: bool) -> None:
        """While on, writes only append to the changelog: no flush by number of rows and no compaction after a flush."""
        self._bulk = enabled

    def sync(self) -> None:
        """Pending rows become a durable changelog segment."""
        if self._pending:
            self._append_rows(self._pending)
            self._pending = []

    def _append_rows(self, rows: list[tuple]) -> None:
        # seqs are taken from the manifest in the commit that makes the segment visible, so a segment has ordinals
        frame = self.spark.createDataFrame([(k, i, d, v, e) for i, (k, d, v, e) in enumerate(rows)], ROW)
        self._append(frame.coalesce(1), len(rows))

    def append(self, changes: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """Appends a data frame of changes (k, ordinal, v or null, optionally expires_at), of any size, in the order of ordinal.

        ``stream`` is the name and batch number of a stream that it is a batch of; they go into the same commit, and a batch
        that is there already is left out (False).
        """
        self.sync()
        if stream and self.manifests.read().streams.get(stream[0], -1) >= stream[1]:
            return False
        gone = F.col("v").isNull() | (F.col("v")["tag"] == NULL)
        expires = F.col("expires_at").cast("long") if "expires_at" in changes.columns else F.lit(None).cast("long")
        rows = changes.select("k", F.col("ordinal").cast("long").alias("seq"), gone.alias("deleted"), F.when(~gone, F.col("v")).cast(VALUE_TYPE).alias("v"), expires.alias("expires_at"))
        return self._append(rows, None, stream)

    def _append(self, rows: DataFrame, count: int | None, stream: tuple[str, int] | None = None) -> bool:
        folder = f"changelog/{uuid.uuid4().hex}"
        rows.write.parquet(self.files.at(folder))
        if count is None:
            most = self.spark.read.schema(ROW).parquet(self.files.at(folder)).agg(F.max("seq")).first()[0]
            count = 0 if most is None else most + 1

        def add(m: Manifest) -> Manifest:
            done = m.streams if stream is None else {**m.streams, stream[0]: stream[1]}
            if stream and m.streams.get(stream[0], -1) >= stream[1]:
                raise _Stale
            # the segment's base is part of its name in the manifest: its rows are base + ordinal
            named = (*m.segments, f"{m.next_seq}:{folder}") if count else m.segments
            return replace(m, segments=named, next_seq=m.next_seq + count, streams=done)

        if not count:
            self.files.remove(folder)
            if stream is None:
                return True
        try:
            self.manifests.commit(add)
        except _Stale:
            self.files.remove(folder)
            return False
        return True

    def clear(self) -> None:
        """Nothing is left for readers of the new version; older versions keep their files until vacuum."""
        self._pending = []
        self.manifests.commit(lambda m: replace(m, runs=(), segments=(), checkpoint_seq=m.next_seq - 1))

    # ------------------------------------------------------------------------------------------------------- reading

    def _segments(self, names: Sequence[str]) -> DataFrame:
        """Changelog segments as one scan; a row's seq is its segment's base and its ordinal."""
        base = {folder: int(first) for first, folder in (n.split(":", 1) for n in names)}
        rows = self.spark.read.schema(ROW).parquet(*map(self.files.at, base))
        bases = F.create_map(*(F.lit(x) for folder, first in base.items() for x in (folder.rpartition("/")[2], first)))
        first = F.element_at(bases, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return rows.select("k", (F.col("seq") + first).alias("seq"), "deleted", "v", "expires_at")

    def _runs(self, runs: Sequence[Run]) -> DataFrame:
        if self.config.allow_missing_runs:
            runs = [r for r in runs if self.files.exists(r.path)]
        if not runs:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*(self.files.at(r.path) for r in runs))

    def versions(self, manifest: Manifest | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions of keys in [low, high), from the runs that can have such keys, the changelog and pending writes."""
        m = manifest or self.manifests.read()
        out = self._runs([r for r in m.runs if r.meets(low, high)])
        if m.segments:
            out = out.unionByName(self._segments(m.segments))
        if manifest is None and self._pending:
            rows = [(k, m.next_seq + i, d, v, e) for i, (k, d, v, e) in enumerate(self._pending)]
            out = out.unionByName(self.spark.createDataFrame(rows, ROW))
        if low is not None:
            out = out.filter(F.col("k") >= low)
        return out if high is None else out.filter(F.col("k") < high)

    def state(self, version: int | None = None, as_of: int | None = None, low: str | None = None, high: str | None = None, now: int | None = None) -> DataFrame:
        """The live view S(k, seq, v, expires_at). Where one run is all there is to read, nothing has to be resolved."""
        m = self.manifests.read(version) if version is not None else None
        whole = m or self.manifests.read()
        met = [r for r in whole.runs if r.meets(low, high)]
        rows = self.versions(m, low, high)
        if as_of is not None:
            rows = rows.filter(F.col("seq") <= as_of)
        alone = not whole.segments and (m is not None or not self._pending) and (len(met) <= 1 or self._disjoint(met))
        live = (rows if alone else newest(rows)).filter(~F.col("deleted")).drop("deleted")
        return visible_at(live, int(self.clock()) if now is None else now).drop("remaining")

    @staticmethod
    def _disjoint(runs: Sequence[Run]) -> bool:
        order = sorted(runs, key=lambda r: r.smallest_key)
        return all(a.largest_key < b.smallest_key for a, b in zip(order, order[1:], strict=False))

    def _between(self, low: str, high: str) -> DataFrame:
        return self.state(low=low or None, high=high or None)

    def get(self, key: str) -> Any:
        rows = reads.get(self.state(low=key, high=key + "\x00"), key).select("v").take(1)
        return decode(rows[0]["v"]) if rows else None

    def exists(self, key: str) -> bool:
        return reads.exists(self.state(low=key, high=key + "\x00"), key)

    def get_ttl(self, key: str) -> int | None:
        """Seconds left; None if the key is gone or has no limit."""
        rows = reads.get(self.state(low=key, high=key + "\x00"), key).select("expires_at").take(1)
        return None if not rows or rows[0][0] is None else rows[0][0] - int(self.clock())

    def batch_get(self, keys: Sequence[str]) -> list[Any]:
        if not keys:
            return []
        state = self.state(low=min(keys), high=max(keys) + "\x00")
        return [decode(r["v"]) for r in reads.batch_get(state, reads.positions(self.spark, keys)).collect()]

    def batch_get_frame(self, keys: DataFrame) -> DataFrame:
        """The same for a data frame (pos, k) of any size."""
        return reads.batch_get(self.state(), keys, ordered=False)

    def scan_prefix_with_values(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        return reads.scan_prefix(self._between(prefix, succ(prefix)), prefix, limit).select("k", "v")

    def scan_range_with_values(self, start: str = "", end: str = "", limit: int | None = None, end_mode: str = "succ") -> DataFrame:
        return reads.scan_range(self._between(start, succ(end)), start, end, limit, end_mode).select("k", "v")

    scan_prefix_pairs, scan_range_pairs = scan_prefix_with_values, scan_range_with_values

    def scan_range_limit_with_values(self, start: str, end: str, limit: int) -> DataFrame:
        return self.scan_range_with_values(start, end, limit)

    def scan_prefix(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        """Keys only; values aren't read."""
        return self.scan_prefix_with_values(prefix, limit).select("k")

    def scan_range(self, start: str = "", end: str = "", limit: int | None = None, end_mode: str = "succ") -> DataFrame:
        return self.scan_range_with_values(start, end, limit, end_mode).select("k")

    def scan_range_limit(self, start: str, end: str, limit: int) -> DataFrame:
        return self.scan_range(start, end, limit)

    def scan_next(self, prefix: str, after: str | None = None, limit: int = 1) -> DataFrame:
        """The next pairs under a prefix after a key."""
        return reads.scan_next(self._between(max(prefix, after or ""), succ(prefix)), prefix, after, limit).select("k", "v")

    def scan_all(self) -> DataFrame:
        return reads.scan_all(self.state()).select("k", "v")

    def keys(self) -> DataFrame:
        return reads.keys(self.state())

    def iter_range(self, start: str = "", end: str = "") -> Iterator[tuple[str, Any]]:
        for r in self.scan_range_with_values(start, end).toLocalIterator():
            yield r["k"], decode(r["v"])

    def cursor(self, prefix: str) -> reads.PrefixCursor:
        """A cursor over the version of now: later writes and compactions don't show, and its files stay until vacuum."""
        self.sync()
        return reads.PrefixCursor(self.state(version=self.manifests.read().version), prefix)

    def for_each(self, prefix: str, visit) -> int:
        return reads.for_each(self._between(prefix, succ(prefix)), prefix, lambda k, v: visit(k, decode(v)))

    def count(self) -> int:
        return self.state().count()

    def approx_count(self) -> int:
        """By the manifest alone: entries of runs, versions and tombstones included."""
        return sum(r.entry_count for r in self.manifests.read().runs)

    def count_prefix(self, prefix: str) -> int:
        return reads.count_prefix(self._between(prefix, succ(prefix)), prefix)

    def count_range(self, start: str, end: str) -> int:
        return reads.count_range(self._between(start, succ(end)), start, end)

    def snapshot(self, version: int | None = None) -> Snapshot:
        self.sync()
        return Snapshot(self, self.manifests.read(version))

    def begin_transaction(self) -> None:
        raise Unsupported("interactive transactions are not supported; batch_put commits atomically")

    # ------------------------------------------------------------------------------------------------- column families

    def create_column_family(self, name: str) -> None:
        self.manifests.commit(lambda m: m if name in m.families else replace(m, families=(*m.families, name)))

    def drop_column_family(self, name: str) -> None:
        """Takes the family from the catalogue and deletes its rows."""
        self._family(name)
        gone = self._between(f"{name}{CF_SEPARATOR}", succ(f"{name}{CF_SEPARATOR}")).select("k", F.lit(0).alias("ordinal"), F.lit(None).cast(VALUE_TYPE).alias("v"))
        self.append(gone)
        self.manifests.commit(lambda m: replace(m, families=tuple(f for f in m.families if f != name)))

    def list_column_families(self) -> list[str]:
        return list(self.manifests.read().families)

    def _family(self, name: str) -> str:
        if name not in self.manifests.read().families:
            raise ColumnFamilyNotFound(name)
        return name

    def put_cf(self, key: str, value: Any, cf: str = DEFAULT_CF) -> None:
        self.put(cf_key(self._family(cf), key), value)

    def put_cf_with_ttl(self, key: str, value: Any, seconds: int, cf: str = DEFAULT_CF) -> None:
        self.put_with_ttl(cf_key(self._family(cf), key), value, seconds)

    def get_cf(self, key: str, cf: str = DEFAULT_CF) -> Any:
        return self.get(cf_key(self._family(cf), key))

    def get_ttl_cf(self, key: str, cf: str = DEFAULT_CF) -> int | None:
        return self.get_ttl(cf_key(self._family(cf), key))

    def delete_cf(self, key: str, cf: str = DEFAULT_CF) -> None:
        self.delete(cf_key(self._family(cf), key))

    def exists_cf(self, key: str, cf: str = DEFAULT_CF) -> bool:
        return self.exists(cf_key(self._family(cf), key))

    def batch_put_cf(self, items: Iterable[tuple[str, Any]], cf: str = DEFAULT_CF) -> None:
        self._family(cf)
        self.batch_put((cf_key(cf, k), v) for k, v in items)

    def batch_get_cf(self, keys: Sequence[str], cf: str = DEFAULT_CF) -> list[Any]:
        self._family(cf)
        return self.batch_get([cf_key(cf, k) for k in keys])

    def batch_delete_cf(self, keys: Iterable[str], cf: str = DEFAULT_CF) -> None:
        self._family(cf)
        self.batch_delete(cf_key(cf, k) for k in keys)

    def _in_cf(self, cf: str) -> DataFrame:
        name = f"{self._family(cf)}{CF_SEPARATOR}"
        return reads.in_cf(self._between(name, succ(name)), cf)

    def scan_prefix_with_values_cf(self, prefix: str = "", cf: str = DEFAULT_CF, limit: int | None = None, relative: bool = False) -> DataFrame:
        out = reads.scan_prefix(self._in_cf(cf), prefix, limit).select("k", "v")
        return out.withColumn("k", F.substring("k", F.lit(len(prefix) + 1), F.length("k"))) if relative else out

    def scan_range_with_values_cf(self, start: str = "", end: str = "", cf: str = DEFAULT_CF, limit: int | None = None, end_mode: str = "succ") -> DataFrame:
        return reads.scan_range(self._in_cf(cf), start, end, limit, end_mode).select("k", "v")

    def scan_prefix_cf(self, prefix: str = "", cf: str = DEFAULT_CF, limit: int | None = None, relative: bool = False) -> DataFrame:
        return self.scan_prefix_with_values_cf(prefix, cf, limit, relative).select("k")

    def scan_range_cf(self, start: str = "", end: str = "", cf: str = DEFAULT_CF, limit: int | None = None, end_mode: str = "succ") -> DataFrame:
        return self.scan_range_with_values_cf(start, end, cf, limit, end_mode).select("k")

    def scan_range_limit_cf(self, start: str, end: str, limit: int, cf: str = DEFAULT_CF) -> DataFrame:
        return self.scan_range_cf(start, end, cf, limit)

    def scan_all_cf(self, cf: str = DEFAULT_CF) -> DataFrame:
        return self.scan_prefix_with_values_cf("", cf)

    def iter_range_cf(self, start: str = "", end: str = "", cf: str = DEFAULT_CF) -> Iterator[tuple[str, Any]]:
        """The one range whose end includes ``end`` itself and nothing else that begins with it."""
        for r in self.scan_range_with_values_cf(start, end, cf, end_mode="inclusive").toLocalIterator():
            yield r["k"], decode(r["v"])

    # ------------------------------------------------------------------------------------------- flush and compaction

    def flush(self) -> None:
        """The changelog becomes a run at level 0, or as many with disjoint key ranges as its size asks for.

        Should another handle flush or clear the store meanwhile, the run is given up and made from what is left.
        """
        self.sync()
        for _ in range(TRIES):
            now = self.manifests.read()
            if not now.segments:
                break
            size = sum(self.files.size(s.split(":", 1)[1]) for s in now.segments)
            made = self._write_runs(newest(self._segments(now.segments)), 0, compaction.target_partitions(size, self.config.levels.target_size))
            taken, last = set(now.segments), now.next_seq - 1

            def install(m: Manifest, made=made, taken=taken, last=last) -> Manifest:
                if not taken <= set(m.segments):
                    raise _Stale
                return replace(m, runs=(*m.runs, *made), segments=tuple(s for s in m.segments if s not in taken), checkpoint_seq=max(m.checkpoint_seq, last))

            if self._install(install, made):
                break
        else:
            raise CommitConflict(f"no flush in {TRIES} tries")
        if self.config.auto_compact and not self._bulk:
            self.compact_if_needed()

    def _install(self, change, made: Sequence[Run]) -> bool:
        """Commits runs; if that can't be, their files go, and the answer is False if they are to be made again."""
        try:
            self.manifests.commit(change)
            return True
        except _Stale:
            self._discard(made)
            return False
        except BaseException:
            self._discard(made)
            raise

    def _discard(self, made: Sequence[Run]) -> None:
        for folder in {r.path.rpartition("/")[0] for r in made}:
            self.files.remove(folder)

    def _write_runs(self, rows: DataFrame, level: int, parts: int) -> list[Run]:
        """Sorted runs with disjoint key ranges, one folder each, as one job; their entries come from reading them back."""
        folder = f"runs/{run_filename(level, self.manifests.read().next_seq)}_{uuid.uuid4().hex[:8]}"
        spread = rows.repartitionByRange(parts, "k") if parts > 1 else rows.coalesce(1)
        spread.withColumn("_part", F.spark_partition_id()).sortWithinPartitions("k").write.option("parquet.bloom.filter.enabled#k", "true").partitionBy("_part").parquet(self.files.at(folder))
        if not [n for n in self.files.list(folder) if n.startswith("_part=")]:
            self.files.remove(folder)
            return []
        found = self.spark.read.schema(f"{rows.select('k', 'seq').schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, _part int").parquet(self.files.at(folder))
        ends = found.groupBy("_part").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("_part").collect()
        out = []
        for r in ends:
            path = f"{folder}/_part={r['_part']}"
            out.append(Run(f"{folder.rpartition('/')[2]}_{r['_part']}", path, level, r["n"], self.files.size(path), r["lo"], r["hi"], r["a"], r["b"], int(self.clock())))
        return out

    def compact(self, levels: Sequence[int] | None = None, to_level: int | None = None, start: str | None = None, end: str | None = None) -> dict | None:
        """Flushes, then merges the runs of ``levels`` (all if None) that meet the key range into ``to_level``."""
        self.sync()
        if self.manifests.read().segments:
            was, self.config = self.config, replace(self.config, auto_compact=False)
            try:
                self.flush()
            finally:
                self.config = was
        now = self.manifests.read()
        inputs = [r for r in now.runs if (levels is None or r.level in levels) and r.meets(start, succ(end) if end else None)]
        if not inputs:
            return None
        return self._merge(now, inputs, max(1, max(r.level for r in inputs)) if to_level is None else to_level)

    compact_all = compact

    def compact_if_needed(self) -> dict | None:
        """Compacts the first level that the strategy (or, if adaptive, the policy for the workload) finds due."""
        now = self.manifests.read()
        strategy, policy, enabled = self._policy() if self.config.adaptive else (self.config.strategy, self.config.levels, None)
        due = [x for x in compaction.should_compact(now.frame(self.spark), strategy, policy) if enabled is None or x in enabled] if strategy else []
        if not due:
            return None
        level = due[0]
        return self._merge(now, [r for r in now.runs if r.level == level], min(level + 1, policy.levels - 1) if level == 0 else level)

    def _merge(self, now: Manifest, inputs: Sequence[Run], level: int) -> dict:
        """Merges runs. Tombstones, and rows whose time is up, go where nothing older can lie below them; elsewhere rows whose
        time is up become tombstones. Whether that is so is asked again in the commit, and the merge made again if not."""
        read = self._runs(inputs)
        expected, found = sum(r.entry_count for r in inputs), read.count()
        if expected != found:
            raise StorageError(f"runs have {found} rows, the manifest says {expected}")
        names = {r.run_id for r in inputs}
        low, high, last = min(r.smallest_key for r in inputs), max(r.largest_key for r in inputs), max(r.max_seq for r in inputs)
        size = sum(r.file_size for r in inputs)

        def lowest(m: Manifest) -> bool:
            """Whether no other run or segment can have a version older than the newest here of a key in reach."""
            runs = any(r.meets(low, high + "\x00") and r.min_seq < last for r in m.runs if r.run_id not in names)
            return not runs and not any(int(s.split(":", 1)[0]) < last for s in m.segments)

        for _ in range(TRIES):
            drop, clock = lowest(now), int(self.clock())
            gone = F.col("deleted") | (F.coalesce(F.col("expires_at") <= clock, F.lit(False)))
            merged = newest(read)
            if drop:
                merged = merged.filter(~gone)
            else:
                merged = merged.select("k", "seq", gone.alias("deleted"), F.when(~gone, F.col("v")).alias("v"), F.when(~gone, F.col("expires_at")).alias("expires_at"))
            made = self._write_runs(merged, level, compaction.target_partitions(size, self.config.levels.target_size))
            done = {"id": uuid.uuid4().hex, "at": clock, "level": level, "inputs": len(inputs), "outputs": len(made), "processed": expected, "removed": expected - sum(r.entry_count for r in made), "bytes_read": size, "bytes_written": sum(r.file_size for r in made)}

            def install(m: Manifest, drop=drop, made=made, done=done) -> Manifest:
                if not names <= {r.run_id for r in m.runs}:
                    raise StorageError("another change has taken the same runs")
                if drop and not lowest(m):
                    raise _Stale
                return replace(m, runs=(*(r for r in m.runs if r.run_id not in names), *made), compactions=(*m.compactions, done))

            if self._install(install, made):
                if len(self.manifests.read().compactions) > LISTED:
                    self._archive()
                return done
            now = self.manifests.read()
        raise CommitConflict(f"no merge in {TRIES} tries")

    def _archive(self) -> None:
        """Moves the manifest's list of compactions to a file of the history; an entry that is in both counts once."""
        m = self.manifests.read()
        if m.compactions:
            self.files.ensure("history")
            self.files.create(f"history/{m.version:012d}-{uuid.uuid4().hex[:8]}.json", json.dumps(m.compactions))
            ids = {c["id"] for c in m.compactions}
            self.manifests.commit(lambda now: replace(now, compactions=tuple(c for c in now.compactions if c["id"] not in ids)))

    def vacuum(self) -> int:
        """Removes old manifests and the folders that no retained one names; how many folders went.

        What a manifest that goes has named is done with. A folder that no manifest has ever named may be a write that is on
        its way to its commit, so it stays until ``config.orphan_seconds`` after its last change.
        """
        versions = self.manifests.versions()
        kept = versions[-self.config.retained_versions :]
        once: set[str] = set()
        for v in versions[: -self.config.retained_versions]:
            once |= self.manifests.read(v).folders()
        there = [f"{top}/{n}" for top in ("runs", "changelog") for n in self.files.list(top)]
        old = {x for x in there if x not in once and time.time() - self.files.modified(x) > self.config.orphan_seconds}
        if kept:
            self.manifests.forget_before(kept[0])
        # read last, so that what was committed meanwhile is named
        named: set[str] = set()
        for v in self.manifests.versions():
            named |= self.manifests.read(v).folders()
        gone = [x for x in there if x not in named and (x in once or x in old)]
        for name in gone:
            self.files.remove(name)
        return len(gone)

    # ------------------------------------------------------------------------------------------------ adaptive policy

    def is_adaptive_compaction_enabled(self) -> bool:
        return self.config.adaptive

    def update_workload_characteristics(self, write_ops: int, read_ops: int, write_amplification: float = 1.0, read_latency_ms: float = 0.0, resource_utilization: float = 0.0) -> None:
        """What the store is used for, of which the last entries are kept; the newest one steers an adaptive store."""
        entry = {"writes": write_ops, "reads": read_ops, "amplification": float(write_amplification), "p99_ms": 2.0 * read_latency_ms, "resources": float(resource_utilization)}
        row = self.spark.createDataFrame([(write_ops, read_ops)], "writes long, reads long")
        entry["workload"] = row.select(adaptive.workload(F.col("writes"), F.col("reads"))).first()[0]
        self._workloads = [*self._workloads, entry][-adaptive.WORKLOADS_KEPT :]

    def update_performance_metrics(self, write_amplification: float, p50_ms: float, p95_ms: float, p99_ms: float, efficiency: float = 0.0, cpu: float = 0.0, io: float = 0.0, memory: float = 0.0) -> None:
        """Measured performance; it overrides the workload's estimates."""
        entry = {"amplification": float(write_amplification), "p50_ms": float(p50_ms), "p95_ms": float(p95_ms), "p99_ms": float(p99_ms), "efficiency": efficiency, "cpu": float(cpu), "io": float(io), "memory": memory}
        self._performance = [*self._performance, entry][-adaptive.METRICS_KEPT :]

    def get_workload_characteristics(self) -> dict | None:
        return dict(self._workloads[-1]) if self._workloads else None

    def get_performance_metrics(self) -> dict | None:
        return dict(self._performance[-1]) if self._performance else None

    def workload_history(self) -> list[dict]:
        return list(self._workloads)

    def performance_history(self) -> list[dict]:
        return list(self._performance)

    def reset_adaptive(self) -> None:
        self._workloads, self._performance = [], []

    def _policy_row(self) -> DataFrame:
        w = self.get_workload_characteristics() or {"workload": "Unknown", "amplification": 1.0, "p99_ms": 0.0, "resources": 0.0}
        p = self.get_performance_metrics() or {}
        row = (w["workload"], p.get("amplification", w["amplification"]), p.get("p99_ms", w["p99_ms"]), w["resources"], p.get("cpu", 0.0), p.get("io", 0.0))
        return self.spark.createDataFrame([row], "workload string, amplification double, p99_ms double, resources double, cpu double, io double")

    def get_adaptive_level_config(self) -> DataFrame:
        """The level parameters that the newest workload asks for."""
        levels = self.config.levels
        return adaptive.level_config(self._policy_row(), levels.levels, levels.multiplier, levels.max_l0_files).select("level", "workload", "size_multiplier", "max_runs", "compaction_ratio", "enabled")

    def _policy(self) -> tuple[str | None, compaction.LevelPolicy, set[int]]:
        """Strategy (None: not now), level policy and enabled levels for the newest workload."""
        wa, p99, kind = F.col("amplification"), F.col("p99_ms"), F.col("workload")
        chosen = self._policy_row().select(adaptive.strategy(kind, wa, p99, self.config.strategy).alias("strategy"), adaptive.should_schedule(F.col("resources"), F.col("cpu"), F.col("io")).alias("now")).first()
        rows = self.get_adaptive_level_config().collect()
        policy = replace(self.config.levels, multiplier=max(rows[0]["size_multiplier"], 1.1), max_l0_files=max(1, rows[0]["max_runs"]))
        return chosen["strategy"] if chosen["now"] else None, policy, {r["level"] for r in rows if r["enabled"]}

    def shutdown(self) -> None:
        self.flush()

    close = shutdown

    # ---------------------------------------------------------------------------------------------------- statistics

    def manifest_frame(self) -> DataFrame:
        return self.manifests.read().frame(self.spark)

    def stats(self) -> DataFrame:
        """One row: live keys, bytes of values, their mean size, runs, and bytes on disk."""
        m = self.manifests.read()
        size = serialized_size(F.col("v"))
        return self.state().agg(F.count("*").alias("total_keys"), F.coalesce(F.sum(size), F.lit(0)).alias("total_value_bytes"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_value_bytes"), F.lit(len(m.runs)).alias("runs"), F.lit(sum(r.file_size for r in m.runs)).alias("disk_bytes"))

    def level_stats(self) -> DataFrame:
        return stats.level_spine(self.manifest_frame(), self.config.levels.levels)

    def memtable_metrics(self) -> dict[str, int]:
        """What isn't in runs yet: rows of this handle that aren't durable, and the changelog's segments."""
        segments = [s.split(":", 1)[1] for s in self.manifests.read().segments]
        size = sum(2 * len(k.encode()) + sum(len(x) if isinstance(x, (str, bytes)) else 8 for x in v or () if x is not None) for k, _, v, _ in self._pending)
        return {"active_entries": len(self._pending), "active_size": size, "immutable_count": len(segments), "immutable_size": sum(map(self.files.size, segments))}

    def compaction_stats(self) -> list[dict]:
        """Every compaction since the last reset, in order."""
        found = {c["id"]: c for name in self.files.list("history") for c in json.loads(self.files.read(f"history/{name}"))}
        found |= {c["id"]: c for c in self.manifests.read().compactions}
        return sorted(found.values(), key=lambda c: c["at"])

    def reset_compaction_stats(self) -> None:
        self.manifests.commit(lambda m: replace(m, compactions=()))
        self.files.remove("history")

    def column_family_stats(self) -> DataFrame:
        """(cf, keys, bytes) of the families in the catalogue, empty ones too."""
        spine = self.spark.createDataFrame([(f,) for f in self.list_column_families()], "cf string")
        rows = self.state().filter(F.contains("k", F.lit(CF_SEPARATOR))).groupBy(F.substring_index("k", CF_SEPARATOR, 1).alias("cf")).agg(F.count("*").alias("keys"), F.sum(serialized_size(F.col("v"))).alias("bytes"))
        return spine.join(rows, "cf", "left").fillna(0, ["keys", "bytes"])

    def missing_files(self) -> DataFrame:
        """Runs whose files are gone: the manifest without what the listing has."""
        there = [(f"runs/{n}/{p}",) for n in self.files.list("runs") for p in self.files.list(f"runs/{n}")]
        return self.manifest_frame().join(self.spark.createDataFrame(there, "path string"), "path", "left_anti")

    def health_check(self) -> str:
        return "Unhealthy" if self.missing_files().take(1) else "Healthy"

    def recommendations(self, read_ms: float = 0.0, write_ms: float = 0.0, operations: int = 0) -> DataFrame:
        return stats.recommendations(self.manifest_frame(), read_ms, write_ms, len(self.compaction_stats()), operations)

    def metrics_summary(self) -> str:
        """One line of the main figures."""
        row = self.stats().select(stats.summary(F.col("total_keys"), F.col("disk_bytes"), F.lit(1.0), F.lit(0.0), F.lit(self.health_check()))).first()
        return row[0]

    def export_metrics_prometheus(self) -> str:
        m = self.manifests.read()
        rows = [("tidemark_runs", "Runs in the manifest", "gauge", len(m.runs)), ("tidemark_disk_bytes", "Bytes of all runs", "gauge", sum(r.file_size for r in m.runs)), ("tidemark_next_seq", "Next sequence number", "counter", m.next_seq), ("tidemark_compactions_total", "Compactions on record", "counter", len(m.compactions))]
        return stats.prometheus(self.spark.createDataFrame(rows, "name string, help string, kind string, value long")).first()["text"]


class Snapshot:
    """Reads of one manifest version."""

    def __init__(self, store: KvStore, manifest: Manifest) -> None:
        self.store, self.version = store, manifest.version

    def state(self) -> DataFrame:
        return self.store.state(version=self.version) if self.version else self.store.state(as_of=-1)

    def get(self, key: str) -> Any:
        rows = reads.get(self.state(), key).select("v").take(1)
        return decode(rows[0]["v"]) if rows else None

    def exists(self, key: str) -> bool:
        return reads.exists(self.state(), key)

    def scan_prefix(self, prefix: str = "") -> DataFrame:
        return reads.scan_prefix(self.state(), prefix).select("k", "v")

    def scan_range(self, start: str = "", end: str = "") -> DataFrame:
        return reads.scan_range(self.state(), start, end).select("k", "v")


def rows_of(df: DataFrame) -> list[tuple[str, Any]]:
    """A scan's pairs as Python values."""
    def pair(r: Row) -> tuple[str, Any]:
        return r["k"], decode(r["v"])

    return [pair(r) for r in df.collect()]
