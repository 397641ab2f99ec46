import random

import pytest

from tidemark.llm.components import components


def brute(edges):
    group = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = group[a], group[b]
        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("few", [200_000, 0])
def test_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr("tidemark.llm.components.FEW", few)
    monkeypatch.setattr("tidemark.llm.common.LEAST_HOT", 10)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(30)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = [e for e in chain + star + loose + [(-5, 3), (7, 7)] if e[0] != e[1]]
    got = components(spark.createDataFrame([*edges, *edges[:5], (7, 7)], "a long, b long"))
    assert {r[0]: r[1] for r in got.collect()} == brute(edges) and got.count() == len(brute(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
