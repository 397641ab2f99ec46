import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.corpora import frame, odd, sentence
from tests.llm.test_decontamination import brute as leaks_of
from tests.llm.test_line_dedup import LOWER, SPACE
from tests.llm.test_mixing import brute as mix
from tests.llm.test_ngram_join import groups
from tidemark.llm.common import written
from tidemark.llm.quality_fm import THRESHOLD, features, fit


def corpus():
    rng = random.Random(12)
    rows, labels, items = [], [], [(i, sentence(rng, 40)) for i in range(3)]
    for i in range(300):
        text = sentence(rng, rng.randrange(60, 120))
        kind = i % 10
        if kind == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif kind == 1:
            text = " ".join([*text.split()[:30], *items[i % 3][1].split(), *text.split()[30:]])
        elif kind == 2 and i > 100:
            text = rows[i - 100][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(kind != 0), 0))
    return rows, labels, items


def test_stages(spark, tmp_path):
    rows, labels, items = corpus()
    strange = [(None if d is None else d + 1000, *r) for d, *r in odd()]
    frame(spark, rows + strange).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "mixing":
            assert docs.columns == columns
    good, _, one, clean, taken = seen
    junk = {i for i in range(300) if i % 10 == 0}
    assert len(good & junk) <= 1 and len({i for i in range(300)} - junk - good) <= 3
    copies = {i for i in range(300) if i % 10 == 2 and i > 100}
    assert not one & copies
    leaks = {i for i in range(300) if i % 10 == 1}
    assert not clean & leaks and clean >= (one - leaks) & set(range(300))
    assert taken <= clean
    rerun = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert rerun == taken


def by_hand(name, rows, tmp_path, spark, items):
    """(doc_id, text) that a stage keeps of rows (doc_id, text, lang, source, n_chars), by brute force."""
    if name == "quality classifier":
        docs = frame(spark, rows)
        machine = fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
        x = features(pa.array([r[1] for r in rows], pa.string()), np.array([r[4] or 0 for r in rows]))
        kept = []
        for i, r in enumerate(rows):
            at = np.flatnonzero(x.row == i)
            pairs = sum(float(machine.factors[x.bin[a]] @ machine.factors[x.bin[b]]) * x.weight[a] * x.weight[b] for n, a in enumerate(at) for b in at[:n]) if len(at) < 400 else None
            if pairs is None:
                pairs = machine.logits(x)[i] - machine.bias - (machine.linear[x.bin[at]] * x.weight[at]).sum()
            if 1 / (1 + np.exp(-(machine.bias + (machine.linear[x.bin[at]] * x.weight[at]).sum() + pairs))) >= THRESHOLD:
                kept.append((r[0], r[1]))
        return kept
    if name == "line dedup":
        held = defaultdict(set)
        key = lambda line: line.strip(SPACE).translate(LOWER)
        for d, text, *_ in rows:
            for line in (text or "").split("\n") if d is not None else ():
                held[key(line)].add(d)
        lost = lambda d, k: d is not None and len(k) >= 40 and len(held[k]) >= 5 and max(held[k]) != d
        return [(d, None if text is None else "\n".join(x for x in text.split("\n") if not lost(d, key(x)))) for d, text, *_ in rows]
    if name == "n-gram Jaccard join":
        sets, group = groups(rows)
        first = {}
        for i, (s, g) in enumerate(zip(sets, group, strict=True)):
            at = (rows[i][0] is None, rows[i][0] or 0, i)
            if s and (g not in first or at < first[g]):
                first[g] = at
        return [(r[0], r[1]) for i, (r, s, g) in enumerate(zip(rows, sets, group, strict=True)) if not s or first[g][2] == i]
    if name == "benchmark decontamination":
        gone = {d for d, _ in leaks_of([r for r in rows if r[0] is not None], items)}
        return [(r[0], r[1]) for r in rows if r[0] not in gone and not (r[0] is None and leaks_of([r], items))]
    taken = mix([(r[0], r[1], r[2], r[3]) for r in rows])
    return [(r[0], None) for r in taken if r[4] > 0]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    rng = random.Random(4)
    line = sentence(rng, 12)
    # lines that many share, near copies, and edited passages of the benchmark
    rows = [(d, f"{t}\n  {line.upper() if d % 2 else line}" if d % 7 == 3 else t, *r) for d, t, *r in rows[:200]]
    for i in range(20):
        w = rows[i * 3 + 4][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((400 + i, " ".join(w), "en", "s1", 0))
    strange = [(None if d is None else d + 1000, *r) for d, *r in odd() if d != 103]
    frame(spark, rows + strange).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, str(tmp_path)))
        shown = [(r["doc_id"], r["text"] if "text" in docs.columns else None) for r in docs.collect()]
        assert sorted(shown, key=str) == sorted(by_hand(name, before, tmp_path, spark, items), key=str), name
        assert len(shown) < len(before) or name == "line dedup"
