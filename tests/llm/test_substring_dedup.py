import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.corpora import frame, mixed, odd, sentence
from tidemark.llm.substring_dedup import REACH, WINDOW, dedup_substrings, window_marks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, texts = {}, [(d, WORDS.findall(t or "")) for d, t, *_ in rows]
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - WINDOW + 1):
                key = tuple(w[i : i + WINDOW])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - WINDOW + 1) if d is not None else ():
            if first[tuple(w[i : i + WINDOW])] < (d, i):
                gone.update(range(i, i + WINDOW))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(seed):
    """Shared passages of 15 to 60 words at any place, and runs of a word of any length."""
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randrange(15, 60)) for _ in range(6)] + [" ".join(["la"] * n) for n in (2, 3, 19, 20, 21, 50)]
    return [(i, " ".join([sentence(rng, rng.randrange(25)), *rng.choices(shared, k=rng.randrange(1, 4)), sentence(rng, rng.randrange(25))]), "en", "s", 0) for i in range(80)]


def repeated_rows(seed):
    """Short rows that stand two or three times, and different texts under one doc_id, with passages in common."""
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (10, 14, 20, 25, 40)]
    rows = []
    for i in range(60):
        text = " ".join([sentence(rng, rng.randrange(12)), rng.choice(shared), sentence(rng, rng.randrange(12))])
        rows += [(i // 2 if i % 3 else i, text, "en", "s", 0)] * rng.choice((1, 1, 2, 3))
    return rows + [(200 + n, sentence(random.Random(n), n), "en", "s", 0) for n in range(20, 41) for _ in range(2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_and_ids(spark, seed, parts):
    rows = repeated_rows(seed)
    docs = frame(spark, rows).coalesce(1) if parts == 1 else frame(spark, rows)
    assert sorted((tuple(r) for r in dedup_substrings(docs, digest=True).collect()), key=str) == brute(rows)


def test_one_id_with_two_texts_loses_only_what_repeats(spark):
    a, b = sentence(random.Random(1), 60), sentence(random.Random(2), 60)
    rows = [(1, b, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in dedup_substrings(frame(spark, rows).coalesce(1), digest=True).collect())
    assert got == [(1, 0), (5, 0), (5, 60)]


def test_common_names_give_the_same(spark, monkeypatch):
    """A phrase in ever new surroundings, with its windows spread, in small blocks."""
    import tidemark.llm.substring_dedup as module

    monkeypatch.setattr(module, "COMMON", 3)
    monkeypatch.setattr(module, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    phrase = sentence(rng, 14)
    rows = repeats(4) + [(500 + i, f"{sentence(rng, 8)} {phrase} {sentence(rng, 8)}", "en", "s", 0) for i in range(60)] + mixed(3)
    assert sorted((tuple(r) for r in dedup_substrings(frame(spark, rows), digest=True).collect()), key=str) == brute(rows)


def test_texts_are_shuffled_once_for_the_digest(spark):
    out = dedup_substrings(frame(spark, repeats(1)), digest=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("rows", [repeats(1), repeats(2), mixed() + odd(), odd(), []])
def test_against_brute_force(spark, rows):
    assert sorted((tuple(r) for r in dedup_substrings(frame(spark, rows), digest=True).collect()), key=str) == brute(rows)


def test_text_and_other_columns_stay(spark):
    rows = repeats(3) + odd()
    docs = frame(spark, rows, clash=True)
    out = dedup_substrings(docs)
    assert out.schema == docs.schema
    got = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect() if r["doc_id"] is not None)
    assert got == sorted((d, h) for d, _, _, h in brute(rows) if d is not None)
    assert out.filter("doc_id = 100 AND text IS NULL").count() == 1


def test_every_window_has_a_mark_that_its_content_decides():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 50):
        words = rng.integers(1, 1 << 60, alphabet, dtype=np.uint64)
        passage = words[rng.integers(0, alphabet, 60)]
        found = []
        for before in range(6):
            text = np.concatenate((words[rng.integers(0, alphabet, before * 7)], passage, words[rng.integers(0, alphabet, 30)]))
            start, at, name = window_marks(text, np.zeros(len(text), np.int64))
            assert (at - start >= REACH).all() and (at - start <= WINDOW - REACH).all() and (name != np.uint64(2**64 - 1)).all()
            inside = (start >= before * 7) & (start + WINDOW <= before * 7 + 60)
            found.append(list(zip((at - before * 7)[inside].tolist(), name[inside].tolist(), strict=True)))
        assert all(f == found[0] for f in found)
