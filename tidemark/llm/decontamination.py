"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

An item of m words (letters, digits and non-ASCII characters, A-Z lowered) is contained in a document if some passage is
within ``m // 5`` word edits of it. The random walk of Chakraborty, Goldenberg and Koucky copies a word sequence into a
longer one, advancing at each step by a random bit that depends on the step and the word, so that sequences k edits apart
become embeddings that differ in few positions. Each repetition draws a walk and a few positions; windows and items that
agree in those positions of their embeddings are candidates, and the repetitions make up for walks that went apart. Walks
go apart the further the longer they are, so items of more than ``SEGMENT`` words are embedded in overlapping segments, any
one of which makes a candidate.

Windows have the length of a segment and start where they can matter: of an item cut into ``m // 5 + 1`` blocks at least one
stands unchanged in any passage within ``m // 5`` edits, so a window is laid wherever a block of some item occurs, at the
place where the block's segment would begin. That costs no recall and spares embedding the rest of the corpus. A candidate
is then verified by the exact edit distance between the whole item and the best passage around the window.

Defined cases: null or wordless texts and items match nothing; items under five words must occur exactly; repeated rows and
items are each reported; a null doc_id or item_id is reported as null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PUNCTUATION, flat, longs, lowered, mix, pieces, span_hash, table, words, written
from tidemark.llm.packed import heads

#: Edits for each word of an item: one in five.
EDITS = 5
#: Positions compared in each walk, and what REPEATS follows from (see ``repeats_for``): AGREE is such that every length
#: measured reached TARGET at ``m // 5`` edits, deletions alone (the worst kind) included.
SAMPLED, TARGET, AGREE = 3, 0.98, 0.49
#: Words of an item that are embedded together.
SEGMENT = 14
#: Items, and bytes of their texts, that one pass over the documents takes; a larger benchmark takes more passes.
BLOCK_ITEMS, PASS_BYTES = 20_000, 16 << 20
#: Places that are looked at together, and how far before a text one can begin.
PLACES_AT_ONCE, MARGIN = 500_000, 64
_U = np.uint64


def repeats_for(target: float = TARGET, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    """Repetitions for which a pair whose embeddings agree in the fraction ``agree`` is found with probability ``target``."""
    return int(np.ceil(np.log(1 - target) / np.log(1 - agree**sampled)))


REPEATS = repeats_for()


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word, and the bounds of the rows."""
    data, offsets = flat(column)
    data = lowered(data)
    row, first, last, bounds = words(data, offsets, PUNCTUATION)
    return row, span_hash(data, first, last), bounds


def embed(windows: np.ndarray, walks: int) -> np.ndarray:
    """CGK embeddings of word-hash rows of one length: [step, row, walk]; three steps a word, 0 past the end."""
    n, m = windows.shape
    padded = np.concatenate((windows, np.zeros((n, 1), _U)), 1)
    at, rows = np.zeros((n, walks), np.int64), np.arange(n)[:, None]
    draw = np.arange(walks, dtype=_U) * _U(0x9E3779B97F4A7C15)
    out = np.empty((3 * m, n, walks), _U)
    for step in range(3 * m):
        out[step] = now = padded[rows, at]
        at += (mix(now + (draw + _U(step * 0xD1342543DE82EF95 & (1 << 64) - 1))) & _U(1)).astype(np.int64)
        np.minimum(at, m, out=at)
    return out


def _samples(m: int, sampled: int, repeats: int) -> np.ndarray:
    """Positions that each repetition compares, spread over the steps by which a walk is still inside the item."""
    rng = np.random.default_rng(7 * m + 1)
    return np.stack([rng.choice(max(2 * m, sampled), sampled, replace=False) % (3 * m) for _ in range(repeats)])


def _keys(windows: np.ndarray, repeats: int, sampled: int) -> np.ndarray:
    """One key for each window and repetition."""
    m, turn = windows.shape[1], np.arange(repeats)
    seen, key = embed(windows, repeats), np.broadcast_to((turn * 1000 + m).astype(_U), (len(windows), repeats))
    for p in _samples(m, sampled, repeats).T:
        key = mix(key + seen[p, :, turn].T)
    return key


@dataclass
class _Index:
    ids: list
    tokens: list[np.ndarray]
    lengths: np.ndarray
    #: block length: sorted hashes, and of each the length of its segment and its offset from the segment's first word
    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: segment length: sorted keys, and of each the item and the segment's offset in it
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    repeats: int


def segments(m: int) -> np.ndarray:
    """Where the segments of an item of m words begin: as many of ``SEGMENT`` words as cover it, or the item itself."""
    return np.linspace(0, max(m - SEGMENT, 0), -(-m // SEGMENT)).astype(np.int64)


def build_index(ids: list, texts: list, repeats: int = REPEATS) -> _Index:
    _, names, bounds = _tokens(pa.array(texts, pa.string()))
    tokens = [names[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    found: dict[int, list] = {}
    cut: dict[int, list] = {}
    for i, t in enumerate(tokens):
        if len(t):
            edits = len(t) // EDITS
            size = len(t) // (edits + 1)
            starts = np.arange(edits + 1) * size
            # a block is filed under the segment whose middle is nearest to its own
            wide, begin = min(len(t), SEGMENT), segments(len(t))
            near = begin[np.abs(2 * (starts[:, None] - begin) + size - wide).argmin(1)]
            found.setdefault(size, []).append((span_hash(t, starts, starts + size), np.full(edits + 1, wide), starts - near))
            for o in begin.tolist():
                cut.setdefault(wide, []).append((i, o))
    blocks = {}
    for size, rows in found.items():
        h, wide, off = (np.concatenate(x) for x in zip(*rows, strict=True))
        # items that share a block at the same place ask for the same window, and do so once
        order = np.lexsort((off, wide, h))
        h, wide, off = h[order], wide[order], off[order]
        new = heads(h, wide, off)
        blocks[size] = h[new], wide[new], off[new]
    lengths = np.array([len(t) for t in tokens], np.int64)
    keys = {}
    for wide, at in cut.items():
        k = _keys(np.stack([tokens[i][o : o + wide] for i, o in at]), repeats, SAMPLED)
        item, off = np.repeat(np.array(at), k.shape[1], 0).T
        k = k.ravel()
        order = np.argsort(k, kind="stable")
        keys[wide] = k[order], item[order], off[order]
    return _Index(ids, tokens, lengths, blocks, keys, repeats)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j in [lo[i], hi[i])."""
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _places(row: np.ndarray, name: np.ndarray, index: _Index) -> np.ndarray:
    """Distinct (row, start, length): where a segment of that length would begin, wherever one of its item's blocks occurs."""
    found = [np.empty(0, np.int64)]
    low = _U((1 << 20) - 1)
    for size, (hashes, wide, off) in index.blocks.items():
        if len(name) < size:
            continue
        start = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        h = span_hash(name, start, start + size)
        may = np.zeros(1 << 20, bool)
        may[(hashes & low).astype(np.int64)] = True
        hit = np.flatnonzero(may[(h & low).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, h[hit]), np.searchsorted(hashes, h[hit], "right")
        # a block that stands at very many offsets of items is expanded some hits at a time
        for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(hi - lo) // PLACES_AT_ONCE)) + 1):
            i, j = _expand(lo[some], hi[some])
            at = start[hit[some][i]]
            # one number a place, which sorts faster: 26 bits of row, 32 of start (which can lie before the text), 5 of length
            found.append(np.unique(row[at] << 37 | at - off[j] + MARGIN << 5 | wide[j]))
    place = np.unique(np.concatenate(found))
    return np.stack((place >> 37, (place >> 5 & (1 << 32) - 1) - MARGIN, place & 31), 1)


def edit_distance(item: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``around`` the least edits between ``item`` (one for all rows, or one each) and any passage of the row,
    and that passage's end.

    Zeros in ``around`` are filler that equals no word.
    """
    n, width = around.shape
    around = np.ascontiguousarray(around.T)
    ramp = np.arange(width + 1, dtype=np.int32)[:, None]
    row = np.zeros((width + 1, n), np.int32)  # a passage may begin anywhere
    for i, word in enumerate(np.atleast_2d(item).T, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (around != word), row[1:] + 1)
        new -= ramp
        row = np.minimum.accumulate(new, 0) + ramp
    return row.min(0).astype(np.int64), row.argmin(0)


def _search(piece: pa.RecordBatch, index: _Index) -> Iterator[pa.RecordBatch]:
    ids, null = longs(piece.column("doc_id"))
    row, name, bounds = _tokens(piece.column("text"))
    places = _places(row, name, index)
    for m in np.unique(places[:, 2]).tolist():
        mine = places[places[:, 2] == m]
        step = max(1, 4_000_000 // (3 * m * index.repeats))
        for begin in range(0, len(mine), step):
            yield from _matches(mine[begin : begin + step], m, name, bounds, ids, null, index)


def _matches(places: np.ndarray, m: int, name: np.ndarray, bounds: np.ndarray, ids: np.ndarray, null: np.ndarray, index: _Index) -> Iterator[pa.RecordBatch]:
    row, at = places[:, 0], places[:, 1]
    keys, items, offsets = index.keys[m]
    mine = _keys(_cut(name, at, m, bounds[row], bounds[row + 1]), index.repeats, SAMPLED).ravel()
    w, j = _expand(np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right"))
    w //= index.repeats
    length = index.lengths[items[j]]
    # beginnings of one item less than its allowed edits apart are verified together
    step = np.maximum(length // EDITS, 1)
    pairs = np.unique(np.stack((length, items[j], row[w], (at[w] - offsets[j]) // step * step), 1), axis=0)
    # items of one length together
    for size, begin, end in zip(*_runs(pairs[:, 0]), strict=True):
        slack = size // EDITS
        width = size + 2 * slack + max(slack, 1) - 1
        some = max(1, 500_000 // width)
        for a in range(begin, end, some):
            item, r, start = pairs[a : min(a + some, end), 1:].T
            distance, last = edit_distance(np.stack([index.tokens[i] for i in item.tolist()]), _cut(name, start - slack, width, bounds[r], bounds[r + 1]))
            good = distance <= slack
            item, r, start, distance, last = item[good], r[good], start[good], distance[good], last[good]
            if len(r):
                yield table(
                    doc_id=pa.array(ids[r], mask=null[r]), item_id=pa.array([index.ids[i] for i in item.tolist()], pa.int64()), distance=distance,
                    last_word=start - slack + last - 1 - bounds[r], item_words=np.full(len(r), size), row_hash=span_hash(name, bounds[r], bounds[r + 1]).view(np.int64),
                )


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Value, begin and end of each run of equal values."""
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(x)][: len(begin)]


def _cut(name: np.ndarray, start: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``width`` words from each start, 0 where that is outside the text."""
    at = start[:, None] + np.arange(width)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, name[np.clip(at, 0, len(name) - 1)], _U(0))


_SCHEMA = "doc_id long, item_id long, distance long, last_word long, item_words long, row_hash long"


def _passes(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Ids and texts of the distinct items, ``BLOCK_ITEMS`` or ``PASS_BYTES`` at a time on average; equal texts are spread."""
    benchmark = benchmark.select("item_id", "text").distinct()
    size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = 1 + max(size[0] // BLOCK_ITEMS, size[1] // PASS_BYTES)
    for n in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, item_id, distance, last_word, item_words, row_hash): the best passage of each item in each text.

    ``last_word`` counts the text's words from 0; ``row_hash`` tells texts that share a doc_id (or have none) apart.
    """
    spark, found = docs.sparkSession, None
    texts = docs.select("doc_id", "text")
    for ids, items in _passes(benchmark):
        index = spark.sparkContext.broadcast(build_index(ids, items, repeats))

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                yield from _search(piece, index.value)

        one = texts.mapInArrow(run, _SCHEMA)
        found = one if found is None else found.unionByName(one)
    best = F.min(F.struct("distance", "last_word", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id", "row_hash").agg(best).select("doc_id", "item_id", "best.*", "row_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` that contain no item. Rows without doc_id are told apart by their words."""
    leaks = written(find_leaks(docs, benchmark, repeats).select(F.col("doc_id").alias("_leak"), F.col("row_hash").alias("_words")).distinct())
    marked = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at, text = (F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "text"))
    with_id = marked.filter(at.isNotNull()).join(leaks.filter("_leak is not null").select("_leak").distinct(), at == F.col("_leak"), "left_anti")
    if not leaks.filter("_leak is null").take(1):
        return with_id.unionByName(marked.filter(at.isNull())).toDF(*docs.columns)

    def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            _, name, bounds = _tokens(piece.column("t"))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(span_hash(name, bounds[:-1], bounds[1:]).view(np.int64))], [*piece.schema.names, "h"])

    bare = marked.filter(at.isNull()).withColumn("t", text)
    hashed = bare.mapInArrow(words_of, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in bare.schema)}, h long")
    kept = hashed.join(leaks.filter("_leak is null").select("_words"), F.col("h") == F.col("_words"), "left_anti").select(marked.columns)
    return with_id.unionByName(kept).toDF(*docs.columns)


def op4_decontamination(spark, sf_dir):
    """Leaks as (doc_id, item_id, distance, item_words)."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "distance", "item_words")
