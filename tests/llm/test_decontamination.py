import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.corpora import VOCABULARY, frame, odd, sentence
from tidemark.llm import decontamination
from tidemark.llm.decontamination import build_index, decontaminate, edit_distance, find_leaks, repeats_for

TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TOKENS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, item, edits):
    w = list(item)
    for _ in range(edits):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[i] = rng.choice(VOCABULARY)
        elif kind == 1 and len(w) > 1:
            del w[i]
        else:
            w.insert(i, rng.choice(VOCABULARY))
    return w


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, n)) for i, n in enumerate((3, 8, 15, 25, 40, 60, 25, 38))]
    rows = []
    for d in range(120):
        item = rng.choice(items)[1].split()
        w = edited(rng, item, rng.randrange(len(item) // 5 + 3)) if d % 3 else []
        text = f"{sentence(rng, rng.randrange(60))} {', '.join(w).upper() if d % 2 else ' '.join(w)}. {sentence(rng, rng.randrange(60))}"
        rows.append((d, text, "en", "s", 0))
    return rows, items


def brute(rows, items):
    return {(d, i): e for d, text, *_ in rows for i, t in items if words(t) and (e := least_edits(words(t), words(text))) <= len(words(t)) // 5}


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS distance")


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision(spark, seed):
    rows, items = corpus(seed)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(frame(spark, rows, clash=True), items_frame(spark, items)).collect()}
    want = brute(rows, items)
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.9 * len(want)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(got)


@pytest.mark.parametrize("size", [6, 10, 15, 25, 50, 100, 200, 500])
def test_recall_at_every_length(spark, size):
    rng = random.Random(size)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, rows = [], []
    for i in range(60):
        item = new(size)
        items.append((i, " ".join(item)))
        passage = list(item)
        for _ in range(size // 5):
            at = rng.randrange(len(passage))
            # a word replaced, deleted or inserted
            passage[at : at + (i % 3 < 2)] = new(i % 3 != 1)
        rows.append((i, " ".join(new(20) + passage + new(20)), "en", "s", 0))
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(frame(spark, rows), items_frame(spark, items)).collect()}
    assert got <= {(i, i) for i in range(60)} and len(got) >= 0.95 * 60


def test_odd_cases(spark, monkeypatch):
    items = [(1, None), (2, ""), (None, "één ÉÉN 日本 語"), (4, "x"), (5, "a b a b a b"), (5, "a b a b a b"), (6, "long " * 500)]
    rows = odd() + [(7, "word " * 5 + "long " * 500, "en", "s", 0)]
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(frame(spark, rows), items_frame(spark, items)).collect()}
    assert got == {(104, None), (104, 4), (105, 5), (7, 6)}
    kept = decontaminate(frame(spark, rows, clash=True), items_frame(spark, items))
    assert kept.columns == frame(spark, rows, clash=True).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in (104, 105, 7)), key=str)
    assert find_leaks(frame(spark, []), items_frame(spark, items)).count() == 0
    assert decontaminate(frame(spark, rows), items_frame(spark, [])).count() == len(rows)


def test_rows_without_id_are_told_apart(spark):
    rng = random.Random(6)
    item = sentence(rng, 30)
    rows = [(None, f"x {item} y", "en", "s", 0), (None, sentence(rng, 40), "en", "s", 0), (1, item, "en", "s", 0)]
    kept = decontaminate(frame(spark, rows), items_frame(spark, [(1, item)])).collect()
    assert [r["text"] for r in kept] == [rows[1][1]]


def test_pieces_of_the_method():
    rng = random.Random(8)
    assert repeats_for(0.98, 0.6, 3) == 17
    item = np.array([rng.randrange(1, 5) for _ in range(12)], np.uint64)
    around = np.array([[rng.randrange(1, 5) for _ in range(20)] for _ in range(30)], np.uint64)
    distance, _ = edit_distance(item, around)
    assert distance.tolist() == [least_edits(item.tolist(), a.tolist()) for a in around]
    index = build_index([1], ["a b c d e f g h i j"], 4)
    assert {k: len(v[0]) for k, v in index.blocks.items()} == {3: 3}
    assert decontamination._tokens(pa.array(["É a-b  C"]))[2].tolist() == [0, 4]
