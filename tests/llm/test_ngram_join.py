import random
import re

import pytest

from tests.llm.corpora import VOCABULARY, frame, mixed, odd, sentence
from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import near_duplicates, one_of_each

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def groups(rows):
    """For each row its set and the number of its component."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sets, group


def brute(rows):
    sets, group = groups(rows)
    out = []
    for r, s, g in zip(rows, sets, group, strict=True):
        ids = [x[0] for x, y in zip(rows, group, strict=True) if y == g and x[0] is not None]
        out.append((r[0], len(s), r[0] if not s else min(ids, default=None)))
    return sorted(out, key=str)


def near(seed, n=90):
    """Chains of near copies about the threshold, of a few bases."""
    rng = random.Random(seed)
    bases = [sentence(rng, rng.choice((12, 40, 150))).split() for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        cut = rng.randrange(3)
        rows.append((i, " ".join(w[cut:]), "en", "s", 0))
        if rng.random() < 0.2:
            bases.append(w)
    return rows


@pytest.mark.parametrize("rows", [near(1), near(2), mixed() + odd(), odd(), []])
def test_against_brute_force(spark, rows):
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_frequent_shingles_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    rows = near(3)
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_one_of_each(spark):
    rows = near(4) + odd()
    docs = frame(spark, rows, clash=True)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    sets, group = groups(rows)
    want = []
    for g in set(group):
        members = [r for r, x, s in zip(rows, group, sets, strict=True) if x == g and s]
        if members:
            ids = [r[0] for r in members if r[0] is not None]
            want.append(min(ids) if ids else None)
    want += [r[0] for r, s in zip(rows, sets, strict=True) if not s]
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_phrase_that_many_unlike_classes_share(spark, monkeypatch):
    """Short texts around one phrase: its shingles are in all prefixes, and its rows meet in blocks."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 10)
    monkeypatch.setattr("tidemark.llm.common.LEAST_HOT", 5)
    rng = random.Random(7)
    phrase = sentence(rng, 9)
    rows = [(i, f"{sentence(rng, rng.randrange(1, 4))} {phrase} {sentence(rng, rng.randrange(3))}", "en", "s", 0) for i in range(120)]
    rows += near(5, 40) + [(None, phrase, "en", "s", 0)] * 3
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_very_many_copies_and_near_copies(spark):
    """5,000 near copies in a few components, and as many exact copies; no join deals a component or class to one task."""
    rng = random.Random(8)
    bases = [sentence(rng, 60).split() for _ in range(3)]
    rows = []
    for i in range(5000):
        w = list(bases[i % 3])
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(10_000 + i, "one text that is copied very often and has more than five words", "en", "s", 0) for i in range(5000)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows).repartition(6)).collect()}
    assert {got[i] for i in range(10_000, 15_000)} == {10_000}
    assert all(got[i] == i % 3 for i in range(5000))


def test_spread_join_is_a_join(spark, monkeypatch):
    from tidemark.llm.common import spread_join

    monkeypatch.setattr("tidemark.llm.common.LEAST_HOT", 10)
    left = spark.createDataFrame([(i, None if i % 5 == 0 else 1 if i % 5 < 3 else i) for i in range(200)], "id long, k long")
    right = spark.createDataFrame([(k, k * 2) for k in (1, 3, 4, 8, 500)], "k long, v long")
    for how in ("left", "inner", "left_semi"):
        assert sorted(map(str, spread_join(left, right, ["k"], ["id"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
