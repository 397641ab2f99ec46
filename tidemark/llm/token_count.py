"""Token counts by count-only Viterbi over a unigram vocabulary.

A unigram tokenizer picks the segmentation with the highest sum of piece scores. Only the number of pieces is wanted, so the
dynamic program carries the best score and that path's piece count for each end position, and no back pointers. Pieces that
end at a position come from one Aho-Corasick pass, longest first, which is the order of their starts; a later candidate must
be strictly better, so ties fall as in the tokenizer: the earliest start wins, and the unknown character, one character long,
comes last and only where no one-character piece matches. Unknown characters count a token for each UTF-8 byte (byte
fallback).

Text is cut before every space, and a space becomes the sign U+2581, which also starts the text; no piece crosses such a cut,
so a text's count is the sum over its units, and a unit is segmented once for each distinct one in a piece of a batch.

The vocabulary file is a parameter and is read on the driver; what is broadcast is the list of pieces, of fixed size. Files of
byte-pair vocabularies have ranks in place of scores; their pieces get log probabilities by Zipf's law over the ranks, so what
is counted is what a unigram tokenizer with these pieces and scores gives, not what the file's own merges do.

Defined cases: a null or empty text has 0 tokens; text is counted whole; repeated rows are counted one by one.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import flat, pieces, span_hash, words

#: Where the public tokenizers stand, if the environment says nothing else.
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: What an unknown character costs below the least likely piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of units (and of what it takes to file one) whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED, FILED = 32 << 20, 120
_SPACE_ONLY = np.arange(256) == 0x20


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the file's order. A unigram file's scores are taken as they are, ranks become log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(i), model.get_score(i), model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(model.vocab_size())]
    ranked = [s for _, s, special in found if not special]
    if not all(float(s).is_integer() for s in ranked):
        return [(p, float(s)) for p, s, _ in found]
    total = math.log(sum(1 / (r + 1) for r in range(1, len(ranked) + 1)))
    out, rank = [], 0
    for piece, _, special in found:
        rank += not special
        out.append((piece, 0.0 if special else -math.log(rank + 1) - total))
    return out


class Counter:
    """Counts tokens of single units of text."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}
        self.held = 0

    def count(self, unit: str) -> int:
        best: list[float | None] = [0.0] + [None] * len(unit)
        count, single, closed = [0] * (len(unit) + 1), -1, 0
        for last, (length, score) in self.machine.iter(unit):
            end = last + 1
            while closed < end - 1:
                closed += 1
                if single != closed:
                    self._step(unit, closed, best, count)
            now = best[end - length] + score
            if best[end] is None or now > best[end]:
                best[end], count[end] = now, count[end - length] + 1
            if length == 1:
                single = end
        while closed < len(unit):
            closed += 1
            if single != closed:
                self._step(unit, closed, best, count)
        return count[-1]

    def _step(self, unit: str, end: int, best: list, count: list[int]) -> None:
        now = best[end - 1] + self.unknown
        if best[end] is None or now > best[end]:
            best[end], count[end] = now, count[end - 1] + len(unit[end - 1].encode())

    def of(self, raw: bytes) -> int:
        """The count of a space (as MARK) and ``raw``."""
        found = self.known.get(raw)
        if found is None:
            found = self.count(MARK + raw.decode())
            self.held += len(raw) + FILED
            if self.held > REMEMBERED:
                self.known, self.held = {}, len(raw) + FILED
            if self.held <= REMEMBERED:
                self.known[raw] = found
        return found


def counts(column: pa.Array, counter: Counter) -> np.ndarray:
    # the sign itself in a text is as good as a space
    data, offsets = flat(pc.replace_substring(column, MARK, " "))
    row, first, last, bounds = words(data, offsets, _SPACE_ONLY)
    _, at, inverse = np.unique(span_hash(data, first, last), return_index=True, return_inverse=True)
    raw = data.tobytes()
    each = np.array([counter.of(raw[a:b]) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], np.int64)
    total = np.concatenate(([0], np.cumsum(each[inverse])))
    # spaces that no other character follows are units of their own; a text that doesn't begin with one gets one
    spaces = np.concatenate(([0], np.cumsum(data == 0x20)))
    full = offsets[1:] > offsets[:-1]
    bare = np.ones(len(full), bool)
    bare[full] = data[offsets[:-1][full]] != 0x20
    units = spaces[offsets[1:]] - spaces[offsets[:-1]] + (bare & full)
    lone = units - np.diff(bounds)
    return total[bounds[1:]] - total[bounds[:-1]] + lone * counter.of(b"")


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs`` (doc_id, text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(vocabulary.value))
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(vocabulary.value)
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(counts(piece.column("text"), _COUNTERS[key]))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def op6_token_counts(spark, sf_dir):
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
