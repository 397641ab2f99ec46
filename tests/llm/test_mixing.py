import hashlib
import random
import re

import pytest

from tests.llm.corpora import frame, mixed, odd, sentence
from tidemark.llm.mixing import mix_sources

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    size = [len(WORDS.findall(r[1] or "")) for r in rows]
    hashes = [int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:12], 16) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest, weights = sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in free)
        target = {s: 3.0 * total[s] if s in capped else weight[s] * rest / weights for s in names}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        mine = sorted((h, n, i) for i, (h, n, r) in enumerate(zip(hashes, size, rows, strict=True)) if r[3] == s)
        copies = int(target[s] // total[s]) if total[s] else 0
        budget, seen, cut = target[s] - copies * total[s], 0, None
        for h in sorted({h for h, _, _ in mine}):
            n = sum(m for x, m, _ in mine if x == h)
            if seen + n - budget > budget - seen:
                cut = h
                break
            seen += n
        for h, n, i in mine:
            more = 1 if total[s] and budget > 0 and (cut is None or h < cut) else 0
            out.append((rows[i][0], n, total[s], target[s], n * (copies + more)))
    return sorted(out, key=str)


def unequal(seed):
    rng = random.Random(seed)
    return [(i, sentence(rng, rng.choice((0, 3, 40, 200))), "en", rng.choice(("a", "a", "a", "b", "c", None, "é")), 0) for i in range(150)]


@pytest.mark.parametrize("rows", [unequal(1), unequal(2), mixed() + odd(), odd(), []])
def test_against_brute_force(spark, rows):
    got = sorted((tuple(r) for r in mix_sources(frame(spark, rows, clash=True)).collect()), key=str)
    want = brute(rows)
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got] == [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in want]


def test_many_sources(spark, monkeypatch):
    """Ranks over several ranges, caps that are reached one after the other, and sizes of zero."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.choice((0, 1, 3, 9, 27, 81, 243))), "en", f"d{rng.randrange(90)}.example", 0) for i in range(240)]
    got = sorted((tuple(r) for r in mix_sources(frame(spark, rows)).collect()), key=str)
    want = brute(rows)
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got] == [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in want]
    monkeypatch.setattr("tidemark.llm.common.LEAST_HOT", 5)
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in sorted((tuple(r) for r in mix_sources(frame(spark, rows + odd())).collect()), key=str)] == [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in brute(rows + odd())]
    plan = mix_sources(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_near_the_target_and_never_above_the_cap(spark):
    rows = unequal(3)
    got = mix_sources(frame(spark, rows), keep=("source",)).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
