"""Substring dedup by recompression, in two Spark rounds.

Words are the tokens, and symbols rise over them in levels. Each level names runs or pairs of the symbols below; a name is a
hash of its content, so all tasks give equal content equal names without a dictionary that they would have to share:

* level 1 names a run of exactly two equal tokens (longer runs stay as they are: where such a run begins can lie outside the
  passage that repeats);
* levels 2 and 3 name pairs. A level's hash splits the symbols into left and right ones, and a left symbol followed by a right
  one is joined. The choice looks at the two symbols only, so within equal passages all symbols agree but for those near the
  ends.

Where two neighbouring symbols survive the last level there is a *mark*. Whether a position is a mark, and the names of the
symbols on both sides, depend on at most five tokens either way, and marks are at most eight tokens apart, so any window of
20 tokens has marks at its offsets 5 to 15, and equal windows have the same ones. A window belongs to its mark with the
least name (the leftmost such). The mark's own name spans those five tokens on both sides.

* Round 1 *reveals*: every map task sends each mark name that it has once, with a place, and Spark brings equal names together.
  Marks whose name stands at one place only are done with, and so are all windows that belong to them, which is most of a
  text that doesn't repeat. The places of the others go back to their documents.
* Round 2 *verifies*: the windows at shared marks meet under the mark's name, and a window's own 48-bit hash, compared within
  the 64-bit name, decides. Round 1 also counts: the windows of names that stand at very many places (a common phrase in ever
  new surroundings) don't meet under the name but each under 128 bits of its own hash, so no task gets them all.

A map task settles the repeats inside its own block of documents and sends only the first of equal windows, so a passage
that millions of documents share arrives once for each block. Everything but the first occurrence is removed.

Defined cases: a null text has no words; a row without doc_id keeps all its words and takes no part; rows that share a doc_id
are one document as to what is earlier, so of windows that start at the same place in two of them neither is, but each row
loses only what its own text repeats (texts are told apart by 32 bits of hash); windows are judged on the input, not on what is
left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, longs, mix, pieces, span_hash, table, words, written
from tidemark.llm.packed import BUCKET_BYTES, SCHEMA, heads, pack, text_bytes, reduce_buckets

WINDOW = 20
#: Tokens on either side of a mark that it can depend on; see the module's text.
REACH = 5
#: Bytes of text that a map task settles at a time.
BLOCK_BYTES = 6 << 20
#: Bytes packed for each byte of (compressed) input, measured; only sets the number of buckets.
PACKED_RATIO = 1.2
#: Places from which on a name is common, and how many of the most common ones have their windows spread; the driver holds
#: and broadcasts these names (512 kB). Less common ones meet under their name.
COMMON, SPREAD = 4096, 1 << 16

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
#: A name in a block with its first place there and how many it has (65535: or more).
_NAME = np.dtype([("name", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u2")])
_PLACE = np.dtype([("doc", "<i8"), ("at", "<u4")])
_MARK = np.dtype([("name", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("has", "<u2")])
_SINGLE = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<u4")])
#: ``n`` windows of a text that start one after the other, from ``start``.
_RUN = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("n", "<u4")])

# ------------------------------------------------------------------------------------------------------ recompression


def _join(first: np.ndarray, name: np.ndarray, start: np.ndarray, row: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after those at ``first`` are joined with their right neighbours under the names ``new``."""
    keep = np.ones(len(name), bool)
    keep[first + 1] = False
    name = name.copy()
    name[first] = new
    return name[keep], start[keep], row[keep]


def _name_runs(name: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    same = np.zeros(len(name) + 1, bool)  # same[i]: symbols i - 1 and i are equal and of one row
    same[1:-1] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    first = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:])
    return _join(first, name, start, row, mix(name[first] * _U(0xC2B2AE3D27D4EB4F) + _U(2)))


def _pairs(name: np.ndarray, row: np.ndarray, turn: int) -> np.ndarray:
    left = (mix(name + _U(0xA0761D6478BD642F * (turn + 1) & (1 << 64) - 1)) & _U(1)).astype(bool)
    return np.flatnonzero(left[:-1] & ~left[1:] & (row[1:] == row[:-1]))


def _pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9FB21C651E98DF25) + mix(b))


def marks(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token its mark's name, or the largest value where it is no mark. ``name``: one hash a token."""
    out = np.full(len(name), _NONE)
    if len(name) < 2:
        return out
    name, start, row = _name_runs(name, np.arange(len(name)), row)
    if len(name) > 1:
        first = _pairs(name, row, 0)
        name, start, row = _join(first, name, start, row, _pair_name(name[first], name[first + 1]))
    if len(name) > 1:
        stays = np.ones(len(name), bool)
        stays[0] = False
        stays[_pairs(name, row, 1) + 1] = False
        stays[1:] &= row[1:] == row[:-1]
        at = np.flatnonzero(stays)
        out[start[at]] = np.minimum(_pair_name(name[at - 1], name[at]), _NONE - _U(1))
    return out


def window_marks(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one row, and the position and name of the mark that each belongs to."""
    n = len(name) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    mark = marks(name, row)
    least = mark.copy()
    width, span = 1, WINDOW - 2 * REACH + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    least = least[REACH : REACH + n]
    offset = np.zeros(n, np.int64)
    for off in range(WINDOW - REACH, REACH - 1, -1):
        offset[mark[off : off + n] == least] = off
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    at = start + offset[start]
    return start, at, mark[at]


# ----------------------------------------------------------------------------------------------------- round 1: reveal


class _Parsed:
    """The windows of a piece: row, doc_id, 32 bits of the text, start and mark in it, the mark's name."""

    def __init__(self, ids: pa.Array, column: pa.Array) -> None:
        ids, null = longs(ids)
        data, offsets = flat(column)
        row, first, last, self.bounds = words(data, offsets)
        self.token = span_hash(data, first, last)
        self.text = (span_hash(self.token, self.bounds[:-1], self.bounds[1:]) >> _U(32)).astype(np.uint32)
        start, at, symbol = window_marks(self.token, row)
        mine = ~null[row[start]]
        self.start, self.at, self.row = start[mine], at[mine], row[start[mine]]
        # a mark depends on the tokens in reach, so equal windows agree in those too; with them in its name, short symbols of
        # common words don't gather all texts in one bucket
        self.name = mix(symbol[mine] ^ span_hash(self.token, self.at - REACH, self.at + REACH))
        self.doc = ids[self.row]


def _reveal(buckets: int):
    """Names by bucket (kind 0), and places already known to be shared by document (kind 1)."""

    def block(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(name):
            return
        order = np.argsort(name, kind="stable")
        head = heads(name[order])
        size = np.diff(np.append(head, len(name)))
        again = order[np.repeat(size > 1, size)]
        if len(again):
            yield _pack_places(doc[again], at[again], buckets)
        rows, pick = np.zeros(len(head), _NAME), order[head]
        rows["name"], rows["doc"], rows["at"], rows["n"] = name[pick], doc[pick], at[pick], np.minimum(size, 65535)
        yield pack((rows["name"] % _U(buckets)).astype(np.int64), 0, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for piece in pieces(batches):
            p = _Parsed(piece.column("doc_id"), piece.column("text"))
            # windows of one mark stand together
            head = heads(p.row, p.at)
            parts.append((p.name[head], p.doc[head], (p.at - p.bounds[p.row])[head]))
            held += piece.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield from block(parts)
                parts, held = [], 0
        if parts:
            yield from block(parts)

    return run


def _pack_places(doc: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows = np.zeros(len(doc), _PLACE)
    rows["doc"], rows["at"] = doc, at
    return pack((mix(rows["doc"].astype(np.int64).view(_U)) % _U(buckets)).astype(np.int64), 1, rows)


def _shared(bucket: int, held: dict[int, bytes], buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    """Places of names that more than one block has (kind 1), and the common names with their number of places (kind 2)."""
    if 1 in held:
        rows = np.frombuffer(held[1], _PLACE)
        yield pack(np.full(len(rows), bucket), 1, rows)
    if 0 not in held:
        return
    rows = np.frombuffer(held[0], _NAME)
    rows = rows[np.argsort(rows["name"], kind="stable")]
    head = heads(rows["name"])
    size = np.diff(np.append(head, len(rows)))
    # a block with several places has sent them all
    met = rows[np.repeat(size > 1, size) & (rows["n"] == 1)]
    if len(met):
        yield _pack_places(met["doc"], met["at"], buckets)
    total = np.add.reduceat(rows["n"].astype(np.int64), head)
    often = np.flatnonzero(total >= common)
    if len(often):
        yield pack(np.full(len(often), bucket), 2, np.stack((rows["name"][head][often], total[often].astype(_U)), 1))


def _places_by_doc(bucket: int, held: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    rows = np.frombuffer(held[1], _PLACE)
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]
    rows = rows[heads(rows["doc"], rows["at"])]
    yield _blobs(rows["doc"], np.ascontiguousarray(rows["at"]), "marks")


def _blobs(doc: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """One row (_of, rows) for each document; ``doc`` is in order."""
    head = heads(doc)
    ends = np.append(head[1:], len(rows))
    return pa.RecordBatch.from_arrays([pa.array(doc[head].astype(np.int64)), pa.array([rows[a:b].tobytes() for a, b in zip(head, ends, strict=True)], pa.binary())], ["_of", name])


def _common(round1: DataFrame) -> np.ndarray:
    """The most common names, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                pair = np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 2)
                yield table(name=pair[:, 0].copy(), n=pair[:, 1].copy())

    found = round1.filter("kind = 2").select("rows").mapInArrow(run, "name long, n long").orderBy(F.desc("n"), "name").limit(SPREAD)
    return np.sort(found.select("name").toPandas()["name"].to_numpy(np.int64).view(_U))


# ----------------------------------------------------------------------------------------------------- round 2: verify


def _candidates(buckets: int, common):
    """Of documents (doc, text, marks: places of shared names) the windows at those marks, packed; see ``_block``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0
        for piece in pieces(batches):
            some = piece.filter(piece.column("marks").is_valid())
            if not some.num_rows:
                continue
            p = _Parsed(some.column("doc"), some.column("text"))
            shared = np.zeros(len(p.token) + 1, bool)
            for i, blob in enumerate(some.column("marks")):
                at = np.frombuffer(blob.as_buffer(), "<u4").astype(np.int64) + p.bounds[i]
                shared[at[at < p.bounds[i + 1]]] = True
            on = shared[p.at]
            start, at, row, name = p.start[on], p.at[on], p.row[on], p.name[on]
            base, own = p.bounds[row], span_hash(p.token, start, start + WINDOW)
            often = np.searchsorted(common.value, name)
            often = common.value[np.minimum(often, len(common.value) - 1)] == name if len(common.value) else np.zeros(len(name), bool)
            two = np.where(often, span_hash(p.token, start, start + WINDOW, 1), _U(0))
            parts.append((row + rows, p.doc[on], p.text[row], start - base, at - base, name, own, two, often))
            rows += some.num_rows
            held += some.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield from _block(parts, buckets)
                parts, held = [], 0
        if parts:
            yield from _block(parts, buckets)

    return run


def _block(parts: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed marks (kind 0) with their windows' hashes (kind 2), windows of common names (kind 3) and settled removals (kind 1)."""
    row, doc, text, start, at, name, own, two, often = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(doc):
        return
    order = np.argsort(own, kind="stable")
    # of each group of equal windows the least (doc, start)
    head = heads(own[order], name[order])
    size = np.diff(np.append(head, len(order)))
    first = np.ones(len(doc), bool)
    many = np.repeat(size > 1, size)
    if many.any():
        pick = order[many]
        group = np.repeat(np.arange(len(size)), size)[many]
        first[pick] = _is_first(group, doc[pick], start[pick])
    lost = ~first
    if lost.any():
        yield _pack_lost(doc[lost], text[lost], start[lost], buckets)
    alone = first & often
    if alone.any():
        rows = np.zeros(int(alone.sum()), _SINGLE)
        rows["one"], rows["two"], rows["doc"], rows["text"], rows["start"] = own[alone], two[alone], doc[alone], text[alone], start[alone]
        yield pack((mix(rows["one"].copy()) % _U(buckets)).astype(np.int64), 3, rows)
    first &= ~often
    if not first.any():
        return
    row, doc, text, start, at, name, own = row[first], doc[first], text[first], start[first], at[first], name[first], own[first]
    # windows in text order: those of one mark stand together
    head = heads(row, at)
    rows = np.zeros(len(head), _MARK)
    rows["name"], rows["doc"], rows["text"], rows["at"] = name[head], doc[head], text[head], at[head]
    bit = _U(1) << (at - start - REACH).astype(_U)
    rows["has"] = np.add.reduceat(bit, head).astype(np.uint16)
    bucket = (rows["name"] % _U(buckets)).astype(np.int64)
    hashes = np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8)[:, :6]
    yield pack(bucket, 0, rows)
    # the same stable order of buckets, so hashes follow their marks; within a mark by start
    yield pack(np.repeat(bucket, np.diff(np.append(head, len(doc)))), 2, hashes)


def _is_first(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether nothing in the same group (groups stand together) has a smaller (doc, start)."""
    head = heads(group)
    size = np.diff(np.append(head, len(group)))
    is_doc = doc == np.repeat(np.minimum.reduceat(doc, head), size)
    least = np.minimum.reduceat(np.where(is_doc, start, np.iinfo(np.int64).max), head)
    return is_doc & (start == np.repeat(least, size))


def _pack_lost(doc: np.ndarray, text: np.ndarray, start: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Removed windows as runs, to meet by document."""
    doc, text, start = doc.astype(np.int64), text.astype(np.int64), start.astype(np.int64)
    order = np.lexsort((start, text, doc))
    order = order[heads(doc[order], text[order], start[order])]
    doc, text, start = doc[order], text[order], start[order]
    head = heads(doc, text, start - np.arange(len(start)))
    rows = np.zeros(len(head), _RUN)
    rows["doc"], rows["text"], rows["start"], rows["n"] = doc[head], text[head], start[head], np.diff(np.append(head, len(doc)))
    return pack((mix(doc[head].view(_U)) % _U(buckets)).astype(np.int64), 1, rows)


def _settle(bucket: int, held: dict[int, bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of equal windows in this bucket all but the first, as packed runs, and what blocks have settled."""
    if 1 in held:
        rows = np.frombuffer(held[1], _RUN)
        yield pack(np.full(len(rows), bucket), 1, rows)
    if 3 in held:
        rows = np.frombuffer(held[3], _SINGLE)
        yield from _lost(rows["one"], rows["two"], rows["doc"], rows["text"], rows["start"].astype(np.int64), buckets)
    if 0 not in held:
        return
    rows = np.frombuffer(held[0], _MARK)
    bits = ((rows["has"][:, None] >> np.arange(WINDOW - 2 * REACH + 1, dtype=np.uint16)) & 1).astype(bool)
    # by start, so the largest offset first: as the hashes stand
    mark, offset = np.nonzero(bits[:, ::-1])
    start = rows["at"].astype(np.int64)[mark] - REACH - (WINDOW - 2 * REACH - offset)
    own = np.zeros((len(mark), 8), np.uint8)
    own[:, :6] = np.frombuffer(held[2], np.uint8).reshape(-1, 6)
    yield from _lost(own.view(_U).ravel(), rows["name"][mark], rows["doc"][mark], rows["text"][mark], start, buckets)


def _lost(one: np.ndarray, two: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows that have an earlier one with the same two hashes."""
    both = mix(two + one * _U(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    b = both[order]
    same = np.zeros(len(b) + 1, bool)
    same[1:-1] = (b[1:] == b[:-1]) & (two[order][1:] == two[order][:-1]) & (one[order][1:] == one[order][:-1])
    many = same[1:] | same[:-1]
    if many.any():
        pick = order[many]
        lost = ~_is_first(np.cumsum(~same[:-1])[many], doc[pick], start[pick])
        if lost.any():
            yield _pack_lost(doc[pick][lost], text[pick][lost], start[pick][lost], buckets)


def _runs_by_doc(bucket: int, held: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each document that loses something."""
    rows = np.frombuffer(held[1], _RUN)
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    yield _blobs(rows["doc"], np.ascontiguousarray(rows[["text", "start", "n"]]).astype([("text", "<u4"), ("start", "<u4"), ("n", "<u4")]), "runs")


# ------------------------------------------------------------------------------------------------------------- results


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` with the words of repeated windows removed (kept words joined by one space), or a digest of that.

    Columns of any name pass through; a null text stays null. The digest has doc_id, n_words, n_removed, kept_sha256.
    Both joins with the documents deal them by the same key, so for the digest their texts are shuffled once.
    """
    names = docs.columns
    id_, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    session = docs.sparkSession
    texts = docs.select("doc_id", "text")
    buckets = max(8, round(text_bytes(texts) * PACKED_RATIO / BUCKET_BYTES))
    round1 = written(reduce_buckets(texts.mapInArrow(_reveal(buckets), SCHEMA), buckets, partial(_shared, buckets=buckets, common=COMMON), SCHEMA))
    common = session.sparkContext.broadcast(_common(round1))
    marks = reduce_buckets(round1.filter("kind = 1"), buckets, _places_by_doc, "_of long, marks binary")
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    # rows without an id take no part, but must not meet in one task
    keyed = (renamed.select(id_, text) if digest else renamed).withColumn("_key", F.coalesce(F.col(id_).cast("long"), F.xxhash64(text)))
    # merged whatever their size: they grow with the corpus, and a job should not change its shape as it does
    with_marks = keyed.join(marks.hint("merge"), F.col("_key") == F.col("_of"), "left").select(F.col(id_).alias("doc"), F.col(text).alias("text"), "marks")
    lost = reduce_buckets(with_marks.mapInArrow(_candidates(buckets, common), SCHEMA), buckets, partial(_settle, buckets=buckets), SCHEMA)
    found = reduce_buckets(lost, buckets, _runs_by_doc, "_of long, runs binary").hint("merge")
    joined = keyed.join(found, F.col("_key") == F.col("_of"), "left").drop("_of", "_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            data, offsets = flat(piece.column(text))
            _, first, last, bounds = words(data, offsets)
            n, gone = np.diff(bounds), np.zeros(len(first) + 1, np.int32)
            hit = np.flatnonzero(piece.column("runs").is_valid().to_numpy(zero_copy_only=False) & piece.column(id_).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                token = span_hash(data, first, last)
                own = (span_hash(token, bounds[:-1][hit], bounds[1:][hit]) >> _U(32)).astype(np.int64)
                for i, mine in zip(hit, own, strict=True):
                    of, start, count = np.frombuffer(piece.column("runs")[int(i)].as_buffer(), "<u4").reshape(-1, 3).astype(np.int64).T
                    start, count = start[of == mine], count[of == mine]
                    np.add.at(gone, bounds[i] + start, 1)
                    np.add.at(gone, bounds[i] + start + count - 1 + WINDOW, -1)
            kept = np.cumsum(gone)[:-1] == 0
            raw, out = data.tobytes(), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                out.append(b" ".join([raw[x:y] for x, y in zip(first[a:b][kept[a:b]].tolist(), last[a:b][kept[a:b]].tolist(), strict=True)]))
            if digest:
                removed = n - np.diff(np.concatenate(([0], np.cumsum(kept)))[bounds])
                yield table(doc_id=piece.column(id_).cast(pa.int64()), n_words=n, n_removed=removed, kept_sha256=[hashlib.sha256(x).hexdigest() for x in out])
            else:
                null = piece.column(text).is_null().to_pylist()
                new = pa.array([None if z else x.decode() for x, z in zip(out, null, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if f"c{i}" == text else piece.column(f"c{i}") for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    if digest:
        return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(run, renamed.schema).toDF(*names)


def op8_substring_dedup(spark, sf_dir):
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, w FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, n - 18)) AS i FROM n WHERE n >= 20)),
e AS (SELECT doc_id, i, (row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, i)) > 1 AS again FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM e WHERE again),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM n),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept, count(*) AS m FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j WHERE g.j IS NULL GROUP BY x.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(n.n - coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""
