"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words (A-Z lowered) hashed into ``WORD_BINS`` bins, with weight one over the root of
their number, and one bin for each statistic: shares of character classes, length and variety of words, lines, and the
document's n_chars. The score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise term is half the sum over factors of ``(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``, so a text is scored in time
linear in its features. The model is trained on the driver from a bounded sample of labelled rows: of those whose
crc32(doc_id as text) leaves a remainder modulo ``FOLDS``, the ``SAMPLE`` rows with the least hash of doc_id. Of a sampled
text with more than ``SAMPLE_WORDS`` bins of distinct words, training sees those with the least hash, a sample of the whole text
(``Machine.left_out`` counts the others), so the driver holds at most ``SAMPLE * SAMPLE_WORDS`` of them; scoring takes all. The
model's size is fixed (``BINS * (FACTORS + 1)`` floats), so it can be broadcast whatever the corpus.

Defined cases: a null or empty text has only its statistics and is scored by them; a null n_chars counts as 0; a null
doc_id is never held out and never in the sample; without any labelled row every score is 0.5; several labels for one
doc_id are each a row of the sample; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import distinct_sorted, flat, longs, lowered, mix, pieces, release, span_hash, words

WORD_BINS = 1 << 17
STATISTICS, LEVELS = 16, 32
BINS = WORD_BINS + STATISTICS * LEVELS
FACTORS = 8
SAMPLE, SAMPLE_WORDS = 12_000, 2_048
FOLDS = 5
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.05, 1e-5


def _classes() -> np.ndarray:
    """Character classes as one mask of bytes each: capitals, small letters, digits, !, |, other symbols, stops, non-ASCII."""
    byte = np.arange(256)
    of = lambda chars: np.isin(byte, [ord(c) for c in chars])
    return np.stack(((byte >= 65) & (byte < 91), (byte >= 97) & (byte < 123), (byte >= 48) & (byte < 58), of("!"), of("|"), of("#*$%&<>@~^_=+{}[]\\"), of(".,;:?"), byte >= 128))


_CLASS = _classes()


def _level(x: np.ndarray, scale: float) -> np.ndarray:
    return np.minimum(np.log1p(np.maximum(x, 0) * scale) * 3, LEVELS - 1).astype(np.int64)


@dataclass
class Features:
    """Distinct bins of all rows one after the other, sorted by row: (row, bin, weight)."""

    row: np.ndarray
    bin: np.ndarray
    weight: np.ndarray
    rows: int


def features(texts: pa.Array, n_chars: np.ndarray) -> Features:
    data, offsets = flat(texts)
    row, first, last, bounds = words(data, offsets)
    rows, n = len(offsets) - 1, np.diff(bounds)
    hashed = (span_hash(lowered(data), first, last) % np.uint64(WORD_BINS)).astype(np.int64)
    word_row, bins = distinct_sorted(row, hashed)
    distinct = np.bincount(word_row, minlength=rows)
    size = np.maximum(np.diff(offsets), 1)
    share = []
    for mask in _CLASS:
        total = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
        share.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    letters = np.concatenate(([0], np.cumsum(last - first)))
    some = np.maximum(n, 1)
    # words as long as the one before, and the same word again: tables and repetition
    again = np.zeros(len(row) + 1, np.int64)
    again[2:] = np.cumsum((hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])) if len(row) > 1 else again[2:]
    stats = [
        *(_level(s, 200) for s in share),
        _level(n, 0.05), _level(distinct / some, 50), _level((letters[bounds[1:]] - letters[bounds[:-1]]) / some, 2), _level(lines, 1), _level(n / lines, 0.2),
        _level((again[bounds[1:]] - again[np.minimum(bounds[:-1] + 1, bounds[1:])]) / some, 200), _level(n_chars, 0.01), (n == 0).astype(np.int64),
    ]
    stat_bins = WORD_BINS + np.arange(len(stats))[None] * LEVELS + np.stack(stats, 1)
    row_ = np.concatenate((word_row, np.repeat(np.arange(rows), len(stats))))
    weight = np.concatenate((1 / np.sqrt(np.maximum(distinct, 1))[word_row], np.ones(rows * len(stats))))
    order = np.argsort(row_, kind="stable")
    return Features(row_[order], np.concatenate((bins, stat_bins.ravel()))[order], weight[order].astype(np.float32), rows)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    #: Bins of long sampled texts that training hasn't seen.
    left_out: int = 0

    def logits(self, x: Features) -> np.ndarray:
        return self._forward(x)[0]

    def _forward(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.searchsorted(x.row, np.arange(x.rows))
        add = lambda a: np.add.reduceat(a, starts, 0)  # noqa: E731  every row has its statistics, so none is empty
        vx = self.factors[x.bin] * x.weight[:, None]
        total = add(vx)
        logit = self.bias + add(self.linear[x.bin] * x.weight) + 0.5 * (total**2 - add(vx**2)).sum(1)
        return logit, total, vx

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(row: np.ndarray, bin_: np.ndarray, weight: np.ndarray, label: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad; bins that no row has keep weight 0."""
    rng, n = np.random.default_rng(0), len(label)
    seen = np.zeros(BINS, bool)
    seen[bin_] = True
    made = Machine(0.0, np.zeros(BINS, np.float32), np.where(seen[:, None], rng.normal(0, 0.05, (BINS, FACTORS)), 0).astype(np.float32))
    if not n:
        return made
    rate = np.clip(label.mean(), 0.01, 0.99)
    made.bias = float(np.log(rate / (1 - rate)))
    square = np.full(BINS, 1e-4, np.float32), np.full((BINS, FACTORS), 1e-4, np.float32)
    bounds = np.searchsorted(row, np.arange(n + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for begin in range(0, n, BATCH):
            pick = order[begin : begin + BATCH]
            size = bounds[pick + 1] - bounds[pick]
            at = np.repeat(bounds[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x = Features(np.repeat(np.arange(len(pick)), size), bin_[at], weight[at], len(pick))
            logit, total, vx = made._forward(x)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[pick]).astype(np.float32)
            each = slope[x.row] * x.weight
            used, where = np.unique(x.bin, return_inverse=True)
            grad = np.bincount(where, each, len(used)) + DECAY * made.linear[used]
            square[0][used] += grad**2
            made.linear[used] -= RATE * grad / np.sqrt(square[0][used])
            pull = each[:, None] * (total[x.row] - vx)
            grads = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * made.factors[used]
            square[1][used] += grads**2
            made.factors[used] -= RATE * grads / np.sqrt(square[1][used])
            made.bias -= 0.01 * float(slope.mean())
    return made


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _n_chars(docs: DataFrame) -> Column:
    return F.coalesce(F.col("n_chars"), F.lit(0)).cast("long") if "n_chars" in docs.columns else F.lit(0).cast("long")


def _thinned(x: Features, most: int) -> tuple[Features, np.ndarray]:
    """At most ``most`` bins of words a row, those with the least hash, and all statistics; and how many are left out by row."""
    word = x.bin < WORD_BINS
    order = np.lexsort((mix(x.bin.astype(np.uint64)), ~word, x.row))
    starts = np.searchsorted(x.row, np.arange(x.rows))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - starts[x.row[order]]
    keep = ~word | (rank < most)
    return Features(x.row[keep], x.bin[keep], x.weight[keep], x.rows), np.bincount(x.row[~keep], minlength=x.rows)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Machine:
    """The machine trained on at most ``sample`` labelled rows outside the held-out fold, ``sample_words`` bins of each."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).filter((fold(F.col("_id")) != 0) & F.col("label").isNotNull())
    known = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    rows = docs.select("doc_id", "text", _n_chars(docs).alias("n_chars")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x, left = _thinned(features(piece.column("text"), longs(piece.column("n_chars"))[0]), sample_words)
            ends = np.searchsorted(x.row, np.arange(x.rows + 1)).astype(np.int32)
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(a, kind))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("label"), lists(x.bin, pa.int32()), lists(x.weight, pa.float32()), pa.array(left)], ["doc_id", "label", "bin", "weight", "left"])

    got = rows.select("doc_id", "text", "n_chars", "label").mapInArrow(run, "doc_id long, label int, bin array<int>, weight array<float>, left long").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    bins, weights = got["bin"].combine_chunks(), got["weight"].combine_chunks()
    sizes = bins.value_lengths().to_numpy(zero_copy_only=False) if len(bins) else np.empty(0, np.int64)
    machine = train(np.repeat(np.arange(len(sizes)), sizes), bins.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False), got["label"].to_numpy())
    machine.left_out = int(pc.sum(got["left"]).as_py() or 0)
    del got, bins, weights
    release(docs.sparkSession)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with one more last column, score (0 to 1, higher: better). Columns of any name pass through."""
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(machine)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, f"c{text}"):
            n = np.zeros(piece.num_rows, np.int64) if chars is None else longs(piece.column(f"c{chars}"))[0]
            x = features(piece.column(f"c{text}"), n)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.value.scores(x).astype(np.float64))], [*piece.schema.names, "score"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return renamed.mapInArrow(run, f"{schema}, score double").toDF(*names, "score")


def op5_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text", "n_chars"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
