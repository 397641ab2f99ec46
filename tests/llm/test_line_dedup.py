import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.corpora import frame, mixed, odd
from tidemark.errors import CommitConflict
from tidemark.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5, others=()):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text, *_ in [*rows, *others]:
        if doc is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        lost = [doc is not None and len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != doc for x in lines]
        kept = "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)
        out.append((doc, len(lines), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("rows", [mixed(), mixed(1) + odd(), odd(), []])
def test_against_brute_force(spark, rows):
    assert rows_of(dedup_lines(frame(spark, rows), digest=True)) == brute(rows)


def test_text_and_other_columns_stay(spark):
    rows = mixed() + odd()
    docs = frame(spark, rows, clash=True)
    out = dedup_lines(docs)
    assert out.columns == docs.columns and out.schema == docs.schema and out.count() == len(rows)
    kept = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["drop"]) for r in out.collect() if r["doc_id"] is not None)
    assert kept == sorted((d, h, "x") for d, _, _, h in brute(rows) if d is not None)
    assert out.filter("doc_id = 100 AND text IS NOT NULL").count() == 0


def by_index(rows, pairs, min_chars=40, min_docs=5):
    """What ``apply`` does to ``rows`` with an index of the pairs (key, doc_id)."""
    held = defaultdict(set)
    for key, doc in pairs:
        held[key].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(SPACE).translate(LOWER) for x in lines]
        lost = [doc is not None and len(held[k]) >= min_docs and max(held[k]) != doc for k in keys]
        kept = "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)
        out.append((doc, len(lines), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def pairs_of(rows, min_chars=40):
    return {(k, doc) for doc, text, *_ in rows if doc is not None for k in (x.strip(SPACE).translate(LOWER) for x in (text or "").split("\n")) if len(k) >= min_chars}


@pytest.mark.parametrize("seed", [1, 2])
def test_index_against_brute_force_over_two_sessions(spark, tmp_path, monkeypatch, seed):
    """Random inserts and deletes, some twice, some of documents that aren't there, by two handles in turn."""
    if seed == 2:
        monkeypatch.setattr("tidemark.llm.line_dedup.FILTER_KEYS", 2)
    rng = random.Random(seed)
    rows = [(i * 10 + j, *r[1:]) for j in range(3) for i, r in enumerate([*mixed(seed, 24)])]
    rows += [(900, "\n".join(f"a line that stands in many documents, number {n}" for n in range(8)), "en", "s", 0)]
    rows += [(901 + i, rows[-1][1], "en", "s", 0) for i in range(6)]
    model, folder = set(), str(tmp_path / "index")
    for step in range(6):
        index = LineIndex(spark, folder, shards=3 if step == 0 else 99)
        some = rng.sample(rows, rng.randrange(10, 50))
        if step in (0, 1, 3):
            index.insert(frame(spark, some))
            index.insert(frame(spark, some[:3]))
            model |= pairs_of(some)
        else:
            index.delete(frame(spark, some))
            model -= pairs_of(some)
        if step % 2:
            assert rows_of(LineIndex(spark, folder).apply(frame(spark, rows + odd()), digest=True)) == by_index(rows + odd(), model)
    index.insert(frame(spark, []))
    assert index.vacuum() > 0 and rows_of(index.apply(frame(spark, rows), digest=True)) == by_index(rows, model)
    assert (index._manifest()["shards"] > 3) == (seed == 2)
    index.delete(frame(spark, rows))
    assert sum(r["n_dropped"] for r in index.apply(frame(spark, rows), digest=True).collect()) == 0


def test_index_forgets_nothing_that_was_never_there(spark):
    line = "a line long enough to count, which two documents have"
    one, two = [(1, line, "en", "s", 0)], [(2, line, "en", "s", 0)]
    index = LineIndex(spark, min_docs=2)
    index.delete(frame(spark, one))
    index.insert(frame(spark, one))
    index.insert(frame(spark, two))
    assert rows_of(index.apply(frame(spark, one + two), digest=True)) == by_index(one + two, pairs_of(one + two), min_docs=2)
    with pytest.raises(CommitConflict):
        index.files.create(f"manifest/{index.generation:012d}.json", "{}")


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    made = CuckooFilter.of(keys[:2000])
    assert made.contains(keys[:2000]).all() and made.contains(keys[2000:]).mean() < 0.01
    for k in keys[:1000]:
        assert made.delete(int(k))
    again = CuckooFilter.load(made.dump())
    assert again.contains(keys[1000:2000]).all() and again.contains(keys[:1000]).mean() < 0.02
    assert not CuckooFilter.of(keys[:0]).contains(keys).any()
