import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.corpora import frame, mixed, odd
from tidemark.llm.quality_rules import judge, prior

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def fails(m):
    n, chars, symbols, dup, repeat, lines = m
    return [n < 50, 100 * repeat > 50 * n, 10 * symbols > chars, 100 * dup > 30 * lines, chars < 3 * n or chars > 12 * n]


def brute(rows):
    judged = [(r[0], r[3], measures(r[1])) for r in rows]
    hosts = {h: [fails(m) for _, x, m in judged if x == h] for h in {x for _, x, _ in judged}}
    total, bad = sum(map(len, hosts.values())), set()
    for rule in range(5):
        rate = {h: (sum(f[rule] for f in fs), len(fs)) for h, fs in hosts.items()}
        mean = sum(f for f, _ in rate.values()) / total if total else 0
        spread = sum(n * (f / n - mean) ** 2 for f, n in rate.values())
        room = total - sum(n * n for _, n in rate.values()) / max(total, 1) - (len(rate) - 1)
        alike = (spread / (mean * (1 - mean)) - (len(rate) - 1)) / room if 0 < mean < 1 and room > 0 else 0
        weight = min(max(1 / alike - 1, 5.0), 1e6) if alike > 0 else 1e6
        bad |= {h for h, (f, n) in rate.items() if (f + mean * weight) / (n + weight) > 0.5}
    out = []
    for doc, host, m in judged:
        base = any(fails(m)[:2])
        out.append((doc, *m[:5], base, not base and not (host in bad and any(fails(m)))))
    return sorted(out, key=str)


def dirty():
    """One host of symbols and tables, one clean, one with a single bad document, which isn't enough."""
    clean = " ".join(f"word{i} also{i * 7}" for i in range(40))
    rows = [(i, clean.replace(" ", " ## ") if i % 4 else clean, "en", "dirty", 0) for i in range(20)]
    rows += [(100 + i, clean + f" x{i}", "en", "clean", 0) for i in range(200)]
    return [*rows, (300, clean.replace(" ", " ## "), "en", "small", 0)]


@pytest.mark.parametrize("rows", [mixed() + odd(), dirty(), odd(), []])
def test_against_brute_force(spark, rows):
    assert sorted((tuple(r) for r in judge(frame(spark, rows, clash=True)).collect()), key=str) == brute(rows)


def test_large_hosts_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.LEAST_HOT", 3)
    rows = dirty() + odd()
    assert sorted((tuple(r) for r in judge(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_prior_takes_sampling_off():
    rng = np.random.default_rng(3)
    n = 5
    sums = lambda x: (len(x), n * len(x), n * n * len(x), int(x.sum()), float((x * x / n).sum()))
    # hosts that all have one rate differ by chance only: none of them becomes suspect
    same = rng.binomial(n, 0.3, 2000)
    mean, weight = prior(*sums(same))
    assert abs(mean - 0.3) < 0.02 and weight > 50 and (n + mean * weight) / (n + weight) < 0.5
    # hosts drawn from a beta distribution: its weight comes out
    drawn = rng.binomial(n, rng.beta(0.3 * 8, 0.7 * 8, 20_000))
    mean, weight = prior(*sums(drawn))
    assert abs(mean - 0.3) < 0.02 and abs(weight - 8) < 1
    # one host, no failures, only failures, no rows
    assert [prior(*x)[1] for x in [(1, 9.0, 81.0, 3, 1.0), (2, 4.0, 8.0, 0, 0.0), (2, 4.0, 8.0, 4, 4.0), (0, None, None, None, None)]] == [1e6] * 4


def test_clean_documents_of_a_dirty_host_stay(spark):
    kept = {r["doc_id"] for r in judge(frame(spark, dirty())).filter("kept").collect()}
    assert kept == {0, 4, 8, 12, 16, 300} | {100 + i for i in range(200)}
