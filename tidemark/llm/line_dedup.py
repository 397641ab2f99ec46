"""Line dedup by sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lowered; keys of ``min_chars`` code
points or more count. The reference table holds, exactly, the documents of every key; a key is *active* while
``min_docs`` documents or more hold it, and active keys stand in the cuckoo filter of their shard. A document's keys are
probed in the filters, and only what a filter lets through meets the reference table, which settles it: the line stays in
the largest doc_id holding it and goes from the others. Cuckoo filters can delete, so ``LineIndex.delete`` takes documents
out again and leaves the index as if they had never been inserted.

Defined cases: a null or empty text is one empty line; a row without doc_id is left as it is and counts for nothing; rows
that repeat a doc_id are one document; a document whose lines all go keeps an empty text; input columns of any name come
through (the working columns are looked up by position, not by name).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, flat, longs, lowered, pieces, shared_dir, span_hash, table, words, written
from tidemark.sources.files import Files

MIN_CHARS, MIN_DOCS = 40, 5
#: Rows that one probing group and one filter hold at most, on average.
GROUP_ROWS, FILTER_KEYS = 250_000, 50_000

# -------------------------------------------------------------------------------------------------------------- keys


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each line (rows in order, lines in order), its 128-bit key as two columns, and whether the key counts."""
    breaks = np.flatnonzero(data == 0x0A)
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(per_row)), per_row)
    begin = np.empty(len(row), np.int64)
    opens = np.cumsum(per_row) - per_row
    inner = np.ones(len(row), bool)
    inner[opens] = False
    begin[opens], begin[inner] = offsets[:-1], breaks + 1
    end = np.empty(len(row), np.int64)
    closes = np.cumsum(per_row) - 1
    inner[:] = True
    inner[closes] = False
    end[closes], end[inner] = offsets[1:], breaks
    _, first, last, _ = words(data, offsets)
    if not len(first):
        return row, np.zeros((len(row), 2), np.uint64), np.zeros(len(row), bool)
    at = np.minimum(np.searchsorted(first, begin), len(first) - 1)
    to = np.maximum(np.searchsorted(last, end, "right") - 1, 0)
    inked = (first[at] >= begin) & (last[to] <= end) & (first[at] < last[to])
    begin, end = np.where(inked, first[at], 0), np.where(inked, last[to], 0)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    counts = points[end] - points[begin] >= min_chars
    low = lowered(data)
    return row, np.stack((span_hash(low, begin, end, 0), span_hash(low, begin, end, 1)), 1), counts & inked


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id): the keys that count, once for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids, null = longs(piece.column("doc_id"))
            row, key, counts = _keys(*flat(piece.column("text")), min_chars)
            counts &= ~null[row]
            row, key = row[counts], key[counts]
            order = np.lexsort((key[:, 1], key[:, 0], row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]).any(1)
            yield table(hi=key[new, 0].view(np.int64), lo=key[new, 1].view(np.int64), doc_id=ids[row[new]])

    return docs.select("doc_id", "text").mapInArrow(run, "hi long, lo long, doc_id long")


# ------------------------------------------------------------------------------------------------------------ filters


class CuckooFilter:
    """Membership with deletion: 16-bit fingerprints, two buckets of four slots a key, the second found by the fingerprint.

    A key that finds no room after ``KICKS`` moves doubles the filter, which is then refilled from ``keys``; the exact
    table is always at hand, so no key is ever lost. False positives: about 8 / 65536 a probe.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = 1 << max(2, int(np.ceil(np.log2(max(len(keys), 1) / cls.SLOTS / 0.8 + 1))))
        while True:
            made = cls(np.zeros((size, cls.SLOTS), np.uint16))
            if all(made.insert(int(k)) for k in keys):
                return made
            size *= 2

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.cells) - 1)
        print_ = (keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        one = keys & mask
        return print_.astype(np.uint16), one, one ^ ((print_ * np.uint64(0x5BD1E995)) & mask)

    def insert(self, key: int) -> bool:
        (p,), (a,), (b,) = self._places(np.array([key], np.uint64))
        for at in (a, b):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = p
                return True
        at, p = int(a), int(p)
        for turn in range(self.KICKS):
            slot = turn % self.SLOTS
            p, self.cells[at, slot] = int(self.cells[at, slot]), p
            at ^= (p * 0x5BD1E995) & (len(self.cells) - 1)
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = p
                return True
        return False

    def delete(self, key: int) -> bool:
        (p,), (a,), (b,) = self._places(np.array([key], np.uint64))
        for at in (a, b):
            held = np.flatnonzero(self.cells[at] == p)
            if len(held):
                self.cells[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return ((self.cells[a] == p[:, None]) | (self.cells[b] == p[:, None])).any(1)


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod("lo", F.lit(shards)).cast("int"))


def build_filters(active: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): one row a shard, of the active keys (hi, lo, ...); a shard without keys has none."""

    def build(group: pa.Table) -> pa.Table:
        keys = group["hi"].to_numpy().view(np.uint64)
        return pa.table({"shard": group["shard"][:1].cast(pa.int32()), "filter": pa.array([CuckooFilter.of(keys).dump()], pa.binary())})

    return _sharded(active.select("hi", "lo"), shards).groupBy("shard").applyInArrow(build, "shard int, filter binary")


def update_filters(filters: DataFrame, gone: DataFrame, come: DataFrame, active: DataFrame, shards: int, keep=written) -> DataFrame:
    """The filters after keys ceased (``gone``) or began (``come``) to be active; one that has become too full is rebuilt from
    its shard's ``active`` keys. ``keep`` writes a table that is read twice."""
    change = _sharded(gone.select("hi", "lo", F.lit(-1).alias("change")).unionByName(come.select("hi", "lo", F.lit(1).alias("change"))), shards)

    def update(old: pa.Table, changes: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else changes)["shard"][0].as_py()
        keys, what = changes["hi"].to_numpy().view(np.uint64), changes["change"].to_numpy()
        held = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.of(keys[:0])
        for key in keys[what < 0]:
            held.delete(int(key))
        fits = all(held.insert(int(key)) for key in keys[what > 0])
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held.dump() if fits else None], pa.binary())})

    changed = keep(filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(update, "shard int, filter binary"))
    full = changed.filter("filter IS NULL").select("shard")
    rebuilt = build_filters(_sharded(active.select("hi", "lo"), shards).join(full, "shard", "left_semi"), shards)
    return changed.filter("filter IS NOT NULL").unionByName(rebuilt)


def probe(keys: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """The (hi, lo, doc_id) that their shard's filter lets through. Salting by document spreads a key that many hold."""
    left = _sharded(keys, shards).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(mine: pa.Table, held: pa.Table) -> pa.Table:
        mine = mine.select(["hi", "lo", "doc_id"])
        if not held.num_rows or not mine.num_rows:
            return mine.slice(0, 0)
        return mine.filter(pa.array(CuckooFilter.load(held["filter"][0].as_py()).contains(mine["hi"].to_numpy().view(np.uint64))))

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(run, "hi long, lo long, doc_id long")


# ---------------------------------------------------------------------------------------------------------- decisions


def references(postings: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, keeper) of signed postings (hi, lo, doc_id, change): the documents a key still has, exactly."""
    held = postings.groupBy("hi", "lo", "doc_id").agg(F.sum("change").alias("n")).filter("n > 0")
    return held.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def drops(keys: DataFrame, active: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """(doc_id, drop): the keys whose lines a document loses. ``active`` is (hi, lo, keeper)."""
    passed = probe(keys, filters, shards, salts)
    lost = passed.join(active, ["hi", "lo"]).filter("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))


def _rewritten(docs: DataFrame, lost: DataFrame, min_chars: int, digest: bool) -> DataFrame:
    """Each row with its kept lines: as a digest (doc_id, n_lines, n_dropped, kept_sha256), or with text rewritten."""
    names = docs.columns
    at, with_text = names.index("doc_id"), names.index("text")
    # merged whatever its size: it grows with the corpus, and a job should not change its shape as it does
    lost = lost.select(F.col("doc_id").alias("_lost_id"), "drop").hint("merge")
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    joined = renamed.join(lost, F.col(f"c{at}") == F.col("_lost_id"), "left").drop("_lost_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, f"c{with_text}"):
            texts = piece.column(f"c{with_text}").to_pylist()
            data, offsets = flat(piece.column(f"c{with_text}"))
            drop = piece.column("drop")
            row, key, counts = _keys(data, offsets, min_chars)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            lines, dropped, kept = np.diff(bounds), np.zeros(len(texts), np.int64), [x or "" for x in texts]
            for i in np.flatnonzero(drop.is_valid().to_numpy(zero_copy_only=False)):
                gone = {(x["hi"] & (1 << 64) - 1, x["lo"] & (1 << 64) - 1) for x in drop[int(i)].as_py()}
                a, b = bounds[i], bounds[i + 1]
                stay = [not (c and (int(k[0]), int(k[1])) in gone) for c, k in zip(counts[a:b], key[a:b], strict=True)]
                kept[i] = "\n".join(x for x, s in zip(kept[i].split("\n"), stay, strict=True) if s)
                dropped[i] = len(stay) - sum(stay)
            if digest:
                yield table(doc_id=piece.column(f"c{at}").cast(pa.int64()), n_lines=lines, n_dropped=dropped, kept_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in kept])
            else:
                kept = [None if t is None else k for t, k in zip(texts, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if i == with_text else piece.column(f"c{i}") for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    if digest:
        return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return joined.mapInArrow(run, renamed.schema).toDF(*names)


class _Sizes:
    """Shards and salts for so many active keys and postings: the same bounds on a group at every size."""

    def __init__(self, active: DataFrame, keys: DataFrame) -> None:
        self.shards = 1 + active.count() // FILTER_KEYS
        self.salts = 1 + keys.count() // (GROUP_ROWS * self.shards)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """``docs`` without the lines that other documents keep (see the module); ``digest`` returns counts and a hash instead."""
    with Scratch(docs.sparkSession) as tables:
        keys = tables(line_keys(docs, min_chars))
        active = tables(references(keys.withColumn("change", F.lit(1))).filter(F.col("n_docs") >= min_docs).select("hi", "lo", "keeper"))
        n = _Sizes(active, keys)
        filters = tables(build_filters(active, n.shards))
        lost = written(drops(keys, active, filters, n.shards, n.salts))
    return _rewritten(docs, lost, min_chars, digest)


class LineIndex:
    """The incremental form, in a folder of the shared file system, which any session can open.

    The index is a set of (line key, doc_id) pairs. ``insert`` adds those that aren't there yet and ``delete`` takes away those
    that are, so inserting twice is inserting once, deleting what was never inserted changes nothing, and what was inserted
    and deleted might never have been there. A document inserted with another text under its id has the lines of both.

    Keys are dealt into shards with their own postings, active keys and filter. A change reads and writes those of the shards
    that it touches, in the folder of a new generation, and takes effect when the generation's manifest is created, which only
    one writer can: a job that dies half-way leaves the last generation as it was, and the second of two writers at a time
    gets a ``CommitConflict``. Shards double in number when their active keys outgrow the filters.
    """

    TABLES = {"postings": "hi long, lo long, doc_id long, shard int", "active": "hi long, lo long, keeper long, shard int", "filters": "filter binary, shard int"}

    def __init__(self, spark: SparkSession, folder: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = 8) -> None:
        """Opens the index in ``folder``, or makes one there; one that is there keeps its own parameters."""
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.files = Files(spark, self.folder)
        self.files.ensure("manifest")
        self._fresh = {"generation": 0, "shards": shards, "min_chars": min_chars, "min_docs": min_docs, "parts": {name: {} for name in self.TABLES}}

    def _manifest(self) -> dict:
        """What the newest generation consists of: for each table the generation that wrote a shard of it."""
        made = [n for n in self.files.list("manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifest/{made[-1]}")) if made else self._fresh

    @property
    def generation(self) -> int:
        return self._manifest()["generation"]

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, True)

    def delete(self, docs: DataFrame) -> None:
        self._change(docs, False)

    def _read(self, manifest: dict, name: str, shards: Iterable[int] | None = None) -> DataFrame:
        parts = manifest["parts"][name]
        by_generation: dict[str, list[str]] = {}
        for shard in parts if shards is None else (str(x) for x in shards):
            if shard in parts:
                by_generation.setdefault(parts[shard], []).append(shard)
        out = self.spark.createDataFrame([], self.TABLES[name])
        for folder, some in by_generation.items():
            base = self.files.at(f"{folder}/{name}")
            out = out.unionByName(self.spark.read.schema(self.TABLES[name]).option("basePath", base).parquet(*(f"{base}/shard={x}" for x in some)))
        return out

    def _change(self, docs: DataFrame, insert: bool) -> None:
        now = self._manifest()
        shards, folder = now["shards"], f"generations/{now['generation'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        with Scratch(self.spark) as tables:
            pairs = tables(_sharded(line_keys(docs, now["min_chars"]).distinct(), shards))
            touched = [r[0] for r in pairs.select("shard").distinct().collect()]
            if not touched:
                return
            was = self._read(now, "postings", touched)
            pair = ["hi", "lo", "doc_id", "shard"]
            postings = was.select(pair).unionByName(pairs.select(pair)).distinct() if insert else was.join(pairs, pair, "left_anti")
            # a key that very many documents hold makes a shard large: its pairs are spread by document
            salts = F.pmod(F.xxhash64("doc_id"), F.lit(1 + pairs.count() // GROUP_ROWS))
            parts = {name: dict(now["parts"][name]) for name in self.TABLES}
            self._save(postings.repartition("shard", salts), folder, "postings", touched, parts)
            made = {**now, "generation": now["generation"] + 1, "parts": parts}
            self._settle(made, folder, touched, self._read(now, "active", touched), self._read(now, "filters", touched), tables)
        self.files.create(f"manifest/{made['generation']:012d}.json", json.dumps(made))
        if self._read(made, "active").count() > made["shards"] * FILTER_KEYS:
            self._grow(made)

    def _settle(self, made: dict, folder: str, touched: list[int], was: DataFrame, filters: DataFrame, tables: Scratch) -> None:
        """Active keys and filters of the shards ``touched`` from their postings."""
        shards = made["shards"]
        held = references(self._read(made, "postings", touched).select("hi", "lo", "doc_id", F.lit(1).alias("change")))
        self._save(_sharded(held.filter(F.col("n_docs") >= made["min_docs"]).select("hi", "lo", "keeper"), shards).repartition("shard"), folder, "active", touched, made["parts"])
        active = self._read(made, "active", touched)
        gone, come = was.join(active, ["hi", "lo"], "left_anti"), active.join(was, ["hi", "lo"], "left_anti")
        self._save(update_filters(filters, gone, come, active, shards, tables), folder, "filters", touched, made["parts"])

    def _save(self, df: DataFrame, folder: str, name: str, touched: list[int], parts: dict) -> None:
        df.write.partitionBy("shard").parquet(self.files.at(f"{folder}/{name}"))
        there = set(self.files.list(f"{folder}/{name}"))
        for shard in map(str, touched):
            parts[name].pop(shard, None)
            if f"shard={shard}" in there:
                parts[name][shard] = folder

    def _grow(self, now: dict) -> None:
        """The same pairs in as many shards as their active keys need."""
        shards = now["shards"]
        while self._read(now, "active").count() > shards * FILTER_KEYS:
            shards *= 2
        folder = f"generations/{now['generation'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        made = {**now, "generation": now["generation"] + 1, "shards": shards, "parts": {name: {} for name in self.TABLES}}
        every = list(range(shards))
        with Scratch(self.spark) as tables:
            postings = _sharded(self._read(now, "postings").select("hi", "lo", "doc_id"), shards)
            salts = F.pmod(F.xxhash64("doc_id"), F.lit(1 + postings.count() // (GROUP_ROWS * shards)))
            self._save(postings.repartition("shard", salts), folder, "postings", every, made["parts"])
            empty = lambda name: self.spark.createDataFrame([], self.TABLES[name])
            self._settle(made, folder, every, empty("active"), empty("filters"), tables)
        self.files.create(f"manifest/{made['generation']:012d}.json", json.dumps(made))

    def vacuum(self) -> int:
        """Removes the folders that the newest generation doesn't read; how many. Not while a change is being made."""
        named = {folder for parts in self._manifest()["parts"].values() for folder in parts.values()}
        gone = [x for x in (f"generations/{n}" for n in self.files.list("generations")) if x not in named]
        for x in gone:
            self.files.remove(x)
        return len(gone)

    def apply(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """``docs`` without the lines that other documents of the index keep, or a digest; see ``dedup_lines``."""
        now = self._manifest()
        keys = line_keys(docs, now["min_chars"])
        salts = 1 + keys.count() // (GROUP_ROWS * now["shards"])
        return _rewritten(docs, drops(keys, self._read(now, "active").drop("shard"), self._read(now, "filters"), now["shards"], salts), now["min_chars"], digest)


def op10_line_dedup(spark, sf_dir):
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP10_SQL = r"""
WITH l AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
a AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, a.k IS NOT NULL AND l.doc_id <> a.keeper AS lost FROM l LEFT JOIN a ON l.k = a.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
