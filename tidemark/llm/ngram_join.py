"""N-gram Jaccard join by rare-first prefix filtering, with length, positional and suffix filters.

A document's set is its distinct five-word shingles (A-Z lowered); with one to four words the whole sequence is the only
one. Documents with equal sets are one *class*, known by 64 bits of the set. Two classes link when
``den * |x & y| >= num * |x | y|`` (4/5).

1. One pass counts shingles into a table of hashed slots and gives every document its class. The table (bounded, broadcast)
   orders shingles rare first; the order is the same everywhere, and ties fall back on the shingle's hash. Only the order
   depends on the counts, never the result.
2. Each class sends the prefix of its set, which is all it needs to meet any partner: ``n - ceil(t n) + 1`` shingles. Rows
   meet by shingle, bucket by bucket, and those of shingles with one class end there. Shingles so frequent that their rows
   could fill a task skip the buckets and are grouped by Spark with partial aggregation.
3. Shingles of few classes give all their pairs that pass the length and positional filters. For the others candidates come
   in two rounds. First each shingle's rows are compared with one leader of about their own size, the one with the fewest
   rarer shingles, which is linear in the rows; what links is merged, and only shingles that still join different components
   go on. The second round takes all pairs of different components that share a shingle there and pass the length and
   positional filters. So thousands of near copies cost a few comparisons each instead of all their pairs, and no link that
   could change a component is missed. The rows of a shingle that very many classes share are dealt in blocks, and each pair
   of blocks meets by itself, so such a shingle is the work of many tasks.
   The suffix filter works on candidates of both rounds before a text is touched: of hashed cells, those in which the two
   sets have numbers of different parity bound their symmetric difference from below. 256 cells go with the rows, and as many
   as the set is large with the pairs.
4. A candidate pair is verified once, by intersecting the sets exactly.
5. Classes and components of very many documents are joined in parts (``common.spread_join``).

Defined cases: null text or no words: no set, linked with nothing, component is the own doc_id; null doc_id: takes part in
links, and a component's id is its least doc_id that is not null (null if there is none); repeated rows: one class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, distinct_sorted, flat, lowered, mix, pieces, release, span_hash, spread_join, stable_order, table, words, written
from tidemark.llm.components import components
from tidemark.llm.packed import BUCKET_BYTES, SCHEMA, heads, pack, text_bytes, reduce_buckets

SHINGLE = 5
#: The similarity as a fraction.
NUM, DEN = 4, 5
#: Bounds on the slots of the frequency table (4 bytes each when broadcast and in what a task sends), and in how many pieces a
#: task sends its counts. Beyond the most slots rare shingles can't be told apart, but those are still that fill a slot.
MIN_SLOTS, MAX_SLOTS, CHUNKS = 1 << 17, 1 << 20, 256
#: Rows of a shingle that make a block.
BLOCK_ROWS = 2000
#: A shingle's rows skip the buckets if its slot counts this many and four times the mean.
HOT = 4096
#: Packed bytes for each byte of (compressed) input, measured; only sets the number of buckets.
PACKED_RATIO = 1.4
_SKETCH = ("p0", "p1", "p2", "p3")
#: Classes of a shingle up to which all its pairs are candidates right away, without rounds.
PAIRED = 16
#: Pairs that are looked at together.
PAIRS_AT_ONCE = 500_000
_U = np.uint64
_ROW = np.dtype([("key", "<u8"), ("sid", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, sorted by both, and the size of each row's set."""
    data, offsets = flat(column)
    data = lowered(data)
    row, first, last, bounds = words(data, offsets)
    name, n = span_hash(data, first, last), np.diff(bounds)
    inner = np.flatnonzero(row[: len(row) - length + 1] == row[length - 1 :]) if len(row) >= length else np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < length))
    start = np.concatenate((inner, bounds[short]))
    end = np.concatenate((inner + length, bounds[short + 1]))
    rows = np.concatenate((row[inner], short))
    rows, hashes = distinct_sorted(rows, span_hash(name, start, end))
    return rows, hashes, np.bincount(rows, minlength=len(n))


def _set_ids(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes + _U(0x2545F4914F6CDD1D)))))
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(_U)).view(np.int64)


def _sketches(rows: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the parities of its shingles' number in 256 hashed cells, as four numbers of 64 bits."""
    cell = np.bincount(rows * 256 + (hashes >> _U(56)).astype(np.int64), minlength=n * 256) & 1
    packed = np.packbits(cell.astype(np.uint8).reshape(-1, 256), axis=1)
    return list(np.ascontiguousarray(packed).view(np.int64).T)


def _fine_sketches(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The same with as many cells as a power of two from the set's size on, packed; halves of one fold into a coarser one."""
    ends = np.cumsum(sizes)
    out = []
    for a, b in zip(ends - sizes, ends, strict=True):
        bits = max(8, int(b - a - 1).bit_length())
        cell = (hashes[a:b] & _U((1 << bits) - 1)).astype(np.int64)
        out.append(np.packbits(np.bincount(cell, minlength=1 << bits).astype(np.uint8) & 1).tobytes())
    return out


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _ceil(a, b):
    return -(-a // b)


# ------------------------------------------------------------------------------------------------- counts and classes


def _profile(docs: DataFrame, slots: int) -> DataFrame:
    """Rows of two kinds: (chunk, counts) of a task's shingle counts, and (doc_id, sid, n, sketches) of documents (chunk null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, np.int64)
        for piece in pieces(batches):
            rows, hashes, sizes = shingle_sets(piece.column("text"))
            np.add(seen, np.bincount((hashes & _U(slots - 1)).astype(np.int64), minlength=slots), out=seen)
            sid = _set_ids(rows, hashes, sizes)
            sketch = dict(zip(_SKETCH, _sketches(rows, hashes, len(sizes)), strict=True))
            fine = pa.array(_fine_sketches(rows, hashes, sizes), pa.binary())
            yield table(chunk=pa.nulls(len(sizes), pa.int32()), counts=pa.nulls(len(sizes), pa.binary()), doc_id=piece.column("doc_id").cast(pa.int64()), sid=pa.array(sid, mask=sizes == 0), n=sizes, **sketch, fine=fine)
        if seen.any():
            none = pa.nulls(CHUNKS, pa.int64())
            counts = pa.array([x.tobytes() for x in np.minimum(seen, 0xFFFFFFFF).astype(np.uint32).reshape(CHUNKS, -1)], pa.binary())
            yield table(chunk=np.arange(CHUNKS, dtype=np.int32), counts=counts, doc_id=none, sid=none, n=none, **dict.fromkeys(_SKETCH, none), fine=pa.nulls(CHUNKS, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "chunk int, counts binary, doc_id long, sid long, n long, " + ", ".join(f"{x} long" for x in _SKETCH) + ", fine binary")


def _frequencies(profile: DataFrame, slots: int) -> np.ndarray:
    """The counts of all tasks added up; a reduce task holds one piece of the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(slots // CHUNKS, np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and chunk != now:
                    yield table(chunk=[now], counts=pa.array([total.tobytes()], pa.binary()))
                    total[:] = 0
                now = chunk
                total += np.frombuffer(counts.as_buffer(), np.uint32)
        if now is not None:
            yield table(chunk=[now], counts=pa.array([total.tobytes()], pa.binary()))

    added = profile.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, counts binary")
    often = np.zeros((CHUNKS, slots // CHUNKS), np.int64)
    for r in added.collect():
        often[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(often.ravel(), 0xFFFFFFFF).astype(np.uint32)


# ------------------------------------------------------------------------------------------------------------ prefixes


def _prefixes(docs: DataFrame, counts, slots: int, hot: int, buckets: int) -> DataFrame:
    """Packed prefix rows: kind 0 to meet in their buckets, kind 1 (hot) to pass through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        often, sent, salt = counts.value, set(), TaskContext.get().partitionId()
        parts: list[np.ndarray] = []
        hots: list[np.ndarray] = []
        held = 0
        for piece in pieces(batches):
            rows, hashes, sizes = shingle_sets(piece.column("text"))
            sid = _set_ids(rows, hashes, sizes)
            new = np.zeros(len(sizes), bool)
            for i in np.flatnonzero(sizes):
                if sid[i] not in sent:
                    sent.add(sid[i])
                    new[i] = True
            mine = new[rows]
            rows, hashes = rows[mine], hashes[mine]
            sizes = np.where(new, sizes, 0)
            count = often[(hashes & _U(slots - 1)).astype(np.int64)]
            order = stable_order(rows, count)  # equally rare ones stay in the order of their hashes
            rows, hashes, count = rows[order], hashes[order], count[order]
            pos = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
            n = sizes[rows]
            used = pos < n - _ceil(n * NUM, DEN) + 1
            out = np.zeros(int(used.sum()), _ROW)
            out["key"], out["sid"], out["n"], out["pos"] = hashes[used], sid[rows[used]], n[used], pos[used]
            is_hot = count[used] >= hot
            parts.append(out[~is_hot])
            hots.append(out[is_hot])
            held += len(out)
            if held * _ROW.itemsize > 8 << 20:
                yield from flush(parts, hots, salt)
                parts, hots, held, salt = [], [], 0, salt + 1
        yield from flush(parts, hots, salt)

    def flush(parts: list[np.ndarray], hots: list[np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        cold = np.concatenate(parts) if parts else np.zeros(0, _ROW)
        yield pack((mix(cold["key"]) % _U(buckets)).astype(np.int64), 0, cold)
        warm = np.concatenate(hots) if hots else np.zeros(0, _ROW)
        yield pack((np.arange(len(warm)) // 4096 + salt) % buckets, 1, warm)

    return docs.select("text").mapInArrow(run, SCHEMA)


def _size_class(n):
    """Sizes whose ratio is at most the similarity's inverse, about."""
    return np.floor(np.log(n) / np.log(DEN / NUM))


def _lead_hash(sid: np.ndarray, turn: int) -> np.ndarray:
    return mix(sid.view(_U) + _U(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1))


_SHARED = "key long, sid long, n long, pos long, lead long, lead_n long, lead_pos long"


def _few(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (longer, shorter) of rows that share a shingle and pass the filters, for shingles of ``size`` rows."""
    end = np.repeat(np.cumsum(size), size)
    more = end - np.arange(len(rows)) - 1
    one = np.repeat(np.arange(len(rows)), more)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(more) - more, more)
    n, pos = rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    longer = (n[one] > n[two]) | ((n[one] == n[two]) & (rows["sid"][one] > rows["sid"][two]))
    x, y = np.where(longer, one, two), np.where(longer, two, one)
    left = np.minimum(n[x] - pos[x], n[y] - pos[y])
    good = (DEN * n[y] >= NUM * n[x]) & ((NUM + DEN) * left >= NUM * (n[x] + n[y])) & (pos[y] < _index_prefix(n[y]))
    return x[good], y[good]


def _index_prefix(n):
    """What the shorter set of a pair needs to meet the longer one."""
    return n - _ceil(2 * NUM * n, NUM + DEN) + 1


def _meet(bucket: int, held: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """Of shingles with few classes all candidate pairs (sid, lead; key is null); of the others the rows, each with the leader
    of its shingle and size class; of hot ones the rows without a leader."""
    if 1 in held:
        rows = np.frombuffer(held[1], _ROW)
        none = pa.nulls(len(rows), pa.int64())
        yield table(key=rows["key"].view(np.int64).copy(), sid=rows["sid"].copy(), n=rows["n"].astype(np.int64), pos=rows["pos"].astype(np.int64), lead=none, lead_n=none, lead_pos=none)
    if 0 not in held:
        return
    rows = np.frombuffer(held[0], _ROW)
    order = np.lexsort((rows["sid"], rows["key"]))
    rows = rows[order]
    rows = rows[heads(rows["key"], rows["sid"])]
    head = heads(rows["key"])
    size = np.diff(np.append(head, len(rows)))
    each = np.repeat(size, size)
    few, many = rows[(each > 1) & (each <= PAIRED)], rows[each > PAIRED]
    sizes = size[(size > 1) & (size <= PAIRED)]
    found, slice_ = [np.empty((0, 4), np.int64)], np.cumsum(sizes * sizes // 2) // PAIRS_AT_ONCE
    ends = np.cumsum(sizes)
    for at in np.unique(slice_):
        mine = np.flatnonzero(slice_ == at)
        part = few[ends[mine[0]] - sizes[mine[0]] : ends[mine[-1]]]
        x, y = _few(part, sizes[mine])
        found.append(np.unique(np.stack((part["sid"][x], part["sid"][y], part["n"][x].astype(np.int64), part["n"][y].astype(np.int64)), 1), axis=0))
    pair = np.unique(np.concatenate(found), axis=0)
    if len(pair):
        zero = np.zeros(len(pair), np.int64)
        yield table(key=pa.nulls(len(pair), pa.int64()), sid=pair[:, 0].copy(), n=pair[:, 2].copy(), pos=zero, lead=pair[:, 1].copy(), lead_n=pair[:, 3].copy(), lead_pos=zero)
    if not len(many):
        return
    band, rank = _size_class(many["n"]), _lead_hash(many["sid"], 0)
    order = np.lexsort((rank, many["pos"], band, many["key"]))
    many, band = many[order], band[order]
    head = heads(many["key"], band)
    size = np.diff(np.append(head, len(many)))
    yield table(
        key=many["key"].view(np.int64).copy(), sid=many["sid"].copy(), n=many["n"].astype(np.int64), pos=many["pos"].astype(np.int64),
        lead=np.repeat(many["sid"][head], size), lead_n=np.repeat(many["n"][head], size).astype(np.int64), lead_pos=np.repeat(many["pos"][head], size).astype(np.int64),
    )


# -------------------------------------------------------------------------------------------------------- verification


def _bloom(wanted: DataFrame) -> np.ndarray:
    """Two bits of at most 2**27 for each sid in ``wanted`` (sid), packed: 16 MB at most, whatever the number of sids.

    It only saves shuffling: the joins behind it are exact. Beyond some hundred million sids it lets most through, and then
    the texts of the documents are shuffled whole.
    """
    bits = 1 << min(27, max(16, int(np.ceil(np.log2(wanted.count() * 8 + 1)))))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(made, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], ["bits"])

    made = np.zeros(bits // 8, np.uint8)
    for row in wanted.coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        made |= np.frombuffer(row[0], np.uint8)
    return made


def _bloom_bits(sid: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = sid.view(_U)
    return (u & _U(bits - 1)).astype(np.int64), ((u >> _U(32)) & _U(bits - 1)).astype(np.int64)


def _may_hold(made: np.ndarray, sid: np.ndarray) -> np.ndarray:
    one, two = _bloom_bits(sid, len(made) * 8)
    return ((made[one >> 3] >> (one & 7)) & (made[two >> 3] >> (two & 7)) & 1).astype(bool)


def _held(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` (sid first) whose sid is in ``wanted`` (sid), and a few more."""
    known = rows.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(known.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text): one text for each class in ``wanted`` (sid).

    The Bloom filter keeps most other texts from being shuffled; the join is exact.
    """
    known = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for piece in pieces(batches):
            rows, hashes, sizes = shingle_sets(piece.column("text"))
            sid = _set_ids(rows, hashes, sizes)
            take = []
            for i in np.flatnonzero((sizes > 0) & _may_hold(known.value, sid)):
                if sid[i] not in sent:
                    sent.add(sid[i])
                    take.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(sid[take]), piece.column("text").take(pa.array(take, pa.int64()))], ["sid", "text"])

    found = docs.select("text").mapInArrow(run, "sid long, text string").join(wanted, "sid", "left_semi")
    return found.groupBy("sid").agg(F.min("text").alias("text"))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs (a, b, x, y) of texts whose sets link."""
    for piece in pieces(pieces(batches, "x", 1 << 20), "y", 1 << 20):
        one, hash_one, n = shingle_sets(piece.column("x"))
        two, hash_two, m = shingle_sets(piece.column("y"))
        # a shingle that both sets of a pair have is one less among the distinct ones of both
        row, _ = distinct_sorted(np.concatenate((one, two)), np.concatenate((hash_one, hash_two)))
        union = np.bincount(row, minlength=len(n))
        links = pa.array(DEN * (n + m - union) >= NUM * union)
        yield pa.RecordBatch.from_arrays([piece.column("a").filter(links), piece.column("b").filter(links)], ["a", "b"])


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fine sketches don't rule a link out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            keep = []
            for x, y, n in zip(batch.column("x"), batch.column("y"), both, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                keep.append((NUM + DEN) * apart <= (DEN - NUM) * n)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    one, two = (sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(y)) for x, y in ("ax", "by"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _sids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Texts that no pair needs stay where they are."""
    few = _held(texts, _sids(pairs))
    with_x = pairs.join(few.select(F.col("sid").alias("a"), F.col("text").alias("x")), "a")
    both = with_x.join(few.select(F.col("sid").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify, "a long, b long")


# --------------------------------------------------------------------------------------------------------------- join


def _in_reach(n: str, m: str, pos: str, pos_m: str) -> Column:
    """The length filter, and the positional one: as many as are left from a shared shingle on can be shared at most."""
    left = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(pos_m))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * left >= NUM * (F.col(n) + F.col(m)))


def _alike(n: str, m: str, one: str = "", two: str = "other.") -> Column:
    """The suffix filter: cells whose parities differ, each of which has an element that only one of the sets has."""
    apart = sum((F.bit_count(F.col(f"{one}{p}").bitwiseXOR(F.col(f"{two}{p}"))) for p in _SKETCH), F.lit(0))
    return (NUM + DEN) * apart <= (DEN - NUM) * (F.col(n) + F.col(m))


def _open_rows(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of shingles that still join two components, with their component."""
    rows = shared.select("key", "sid", "n", "pos", *_SKETCH).join(comps.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    spread = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return spread_join(rows, spread, ["key"], ["sid"], "left_semi")


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each row with the leader of its shingle and size class.

    The leader is the class in which the shingle stands earliest: it has the fewest rarer shingles, so of near copies it is the
    one with the fewest changes of its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DEN / NUM)))).cast("int")
    rows = rows.select("key", "sid", "n", "pos", *_SKETCH, band.alias("band"))
    first = F.struct(F.col("pos").alias("first"), F.xxhash64("sid").alias("h"), *(F.col(c).alias(c) for c in ("sid", "n", "pos", *_SKETCH)))
    lead = rows.groupBy("key", "band").agg(F.min(first).alias("lead"))
    met = spread_join(rows, lead, ["key", "band"], ["sid"], "inner").filter("sid <> lead.sid").filter(_in_reach("n", "lead.n", "pos", "lead.pos") & _alike("n", "lead.n", "", "lead."))
    return met.select(F.greatest("sid", "lead.sid").alias("a"), F.least("sid", "lead.sid").alias("b")).distinct()


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components that share a shingle and pass the length and positional filters.

    A shingle's rows are dealt in blocks of ``BLOCK_ROWS`` on average, and two blocks meet under their two numbers: a row goes
    to as many places as its shingle has blocks, and the pairs of a shingle are spread over all of them.
    """
    columns = ("sid", "n", "pos", "component", *_SKETCH)
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
    rows = spread_join(rows, blocks, ["key"], ["sid"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    place = ["key", "lo", "hi"]
    x = rows.select(*place, F.col("block").alias("x_block"), *(F.col(c).alias(f"x_{c}") for c in columns))
    # the shorter one needs only its indexing prefix
    y = rows.filter(F.col("pos") < F.col("n") - F.ceil(2 * NUM * F.col("n") / (NUM + DEN)) + 1).select(*place, F.col("block").alias("y_block"), *(F.col(c).alias(f"y_{c}") for c in columns))
    # rows of one block are together wherever it meets another; they are a pair where it meets itself
    met = x.join(y, place).filter((F.col("lo") == F.least("x_block", "y_block")) & (F.col("hi") == F.greatest("x_block", "y_block"))).filter((F.col("x_component") != F.col("y_component")) & ((F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_sid") > F.col("y_sid"))))).filter(_in_reach("x_n", "y_n", "x_pos", "y_pos") & _alike("x_n", "y_n", "x_", "y_"))
    return met.select(F.greatest("x_sid", "y_sid").alias("a"), F.least("x_sid", "y_sid").alias("b")).distinct()


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sid, component, least): one row a document of ``docs`` (doc_id, text); sid and component are classes
    (null without words), least is the component's least doc_id."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << max(0, int(np.ceil(np.log2(size / 4096 + 1))))))
    with Scratch(docs.sparkSession) as tables:
        profile = tables(_profile(docs, slots))
        often = _frequencies(profile, slots)
        counts = docs.sparkSession.sparkContext.broadcast(often)
        buckets = max(8, round(size * PACKED_RATIO / BUCKET_BYTES))
        met = tables(reduce_buckets(_prefixes(docs, counts, slots, HOT + 4 * int(often.mean()), buckets), buckets, _meet, _SHARED))
        release(docs.sparkSession)
        classes = profile.filter("chunk IS NULL").select("doc_id", "sid", F.col("n").alias("n_shingles"))
        rows = met.filter("key is not null")
        wanted = tables(met.select("sid").unionByName(met.filter("key is null").select(F.col("lead").alias("sid"))).distinct())
        sketches = tables(_held(profile.filter("sid is not null").select("sid", "n", *_SKETCH, "fine"), wanted).join(wanted, "sid", "left_semi").groupBy("sid").agg(*(F.min(p).alias(p) for p in ("n", *_SKETCH, "fine"))))
        shared = rows.select("key", "sid", "n", "pos").join(sketches.select("sid", *_SKETCH), "sid")
        # the buckets have paired few or chosen the first leaders of many; hot rows have theirs from Spark
        near = met.filter((F.col("lead") != F.col("sid")) & _in_reach("n", "lead_n", "pos", "lead_pos")).select(F.greatest("sid", "lead").alias("a"), F.least("sid", "lead").alias("b"), (F.col("n") + F.col("lead_n")).alias("both")).distinct()
        one, two = (sketches.select(F.col("sid").alias(x), *(F.col(p).alias(f"{x}_{p}") for p in _SKETCH)) for x in "ab")
        near = near.join(one, "a").join(two, "b").withColumn("zero", F.lit(0)).filter(_alike("both", "zero", "a_", "b_")).select("a", "b")
        hot = tables(shared.join(rows.filter("lead is null").select("key").distinct(), "key", "left_semi"))
        pairs = tables(_close(near.unionByName(_star(hot)).distinct(), sketches))
        texts = tables(_texts_of(docs, tables(_sids(pairs).distinct())))
        release(docs.sparkSession)
        tested, links = pairs, tables(_links(pairs, texts))
        release(docs.sparkSession)
        comps = components(links, keep=tables)
        shared = tables(_open_rows(tables(shared), comps))
        if shared.take(1):
            pairs = tables(_close(_all_pairs(shared).join(tested, ["a", "b"], "left_anti"), sketches))
            if pairs.take(1):
                more = tables(_texts_of(docs, tables(_sids(pairs).distinct())))
                comps = components(links.unionByName(tables(_links(pairs, more))), keep=tables)
        # the least document of each class, then of each component
        least = classes.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
        comps = tables(comps.select(F.col("node").alias("sid"), "component").join(least, "sid"))
        of = tables(spread_join(comps.select("sid", "component"), comps.groupBy("component").agg(F.min("least").alias("least")), ["component"], ["sid"]))
        every = of.unionByName(least.join(of.select("sid"), "sid", "left_anti").select("sid", F.col("sid").alias("component"), "least"))
        return written(spread_join(classes, every, ["sid"], ["doc_id"]).select("doc_id", "n_shingles", "sid", "component", "least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that links reach from each document."""
    return jaccard_classes(docs).select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, of repeated rows one; rows without words stay.

    Rows are told apart by id and set, so of rows that share both one stays.
    """
    found = jaccard_classes(docs)
    # per component, the least id (nulls last), then the least class
    keep = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("sid").alias("sid"))).alias("k"))
    keep = keep.select(F.col("k.id").alias("_id"), F.col("k.sid").alias("_sid"))
    names = docs.columns
    text = names.index("text")
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, f"c{text}"):
            rows, hashes, sizes = shingle_sets(piece.column(f"c{text}"))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_set_ids(rows, hashes, sizes), mask=sizes == 0)], [*piece.schema.names, "sid"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    keyed = renamed.mapInArrow(run, f"{schema}, sid long")
    at = F.col(f"c{names.index('doc_id')}")
    chosen = keyed.filter("sid is not null").join(keep, (F.col("sid") == F.col("_sid")) & at.eqNullSafe(F.col("_id")), "left_semi")
    # rows that repeat an id and a set: any one, by the least of all its columns
    repeated = chosen.groupBy("sid", at.alias("_of")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("sid").alias("_sid"), "_of")
    many = chosen.join(repeated, (F.col("sid") == F.col("_sid")) & at.eqNullSafe(F.col("_of")), "left_semi")
    one = many.groupBy("sid", at.alias("_of")).agg(F.min(F.struct(*renamed.columns)).alias("r")).select("r.*")
    single = chosen.join(repeated, (F.col("sid") == F.col("_sid")) & at.eqNullSafe(F.col("_of")), "left_anti").select(renamed.columns)
    return keyed.filter("sid is null").select(renamed.columns).unionByName(single).unionByName(one).toDF(*names)


def op7_ngram_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
