import random
import zlib

import numpy as np

from tests.llm.corpora import frame, odd, sentence
from tidemark.llm.quality_fm import FACTORS, Features, Machine, _thinned, features, fit, score, train

import pyarrow as pa


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randrange(20, 90))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " | ".join(text.split()[:40])
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = fit(docs, known)
    truth = {d: q for d, q, _ in labels}
    got = [(r["score"], truth[r["doc_id"]]) for r in score(docs, machine).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) > 80 and np.mean([(s >= 0.3) == q for s, q in got]) > 0.95


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = corpus(200)
    docs = frame(spark, rows)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 0) for d, q, _ in labels]
    one, two = (fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert one.bias == two.bias and (one.linear == two.linear).all() and (one.factors == two.factors).all()


def test_sample_is_bounded_in_words_too(spark):
    rows, labels = corpus(60)
    long_ = " ".join(f"w{i}" for i in range(20_000))
    of = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 5)
    rows, labels = [*rows, (of, long_, "en", "s", 0)], [*labels, (of, 1, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = fit(frame(spark, rows), known, sample_words=500)
    assert 15_000 < one.left_out < 20_000 and (one.linear != 0).sum() < 3_000
    whole = fit(frame(spark, rows), known, sample_words=10**6)
    assert whole.left_out == 0 and (whole.linear != 0).sum() > 15_000
    # what is left is the same for every order of the words, and the statistics stay
    texts = pa.array([long_, " ".join(reversed(long_.split())), "a b"])
    thin, left = _thinned(features(texts, np.zeros(3, np.int64)), 100)
    bins = [thin.bin[thin.row == r] for r in range(3)]
    stats = features(pa.array([""]), np.zeros(1, np.int64)).bin.size
    assert sorted(bins[0]) == sorted(bins[1]) and len(bins[0]) == 100 + stats and len(bins[2]) == 2 + stats and left[2] == 0


def test_odd_cases(spark):
    rows, labels = corpus(100)
    docs = frame(spark, odd(), clash=True).drop("score")
    known = spark.createDataFrame([*labels, (0, None, 0), (None, 1, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    machine = fit(frame(spark, rows), known, sample=50)
    out = score(docs, machine)
    assert out.columns == [*docs.columns, "score"] and all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(odd())
    twice = [r["score"] for r in out.filter("doc_id = 106").collect()]
    assert twice[0] == twice[1]
    untrained = fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in score(docs, untrained).collect()} == {0.5}
    assert score(frame(spark, []), machine).count() == 0


def test_identity_of_the_pairwise_term():
    rng = np.random.default_rng(0)
    x = features(pa.array(["a b c b", "", "d"]), np.zeros(3, np.int64))
    machine = Machine(0.1, rng.normal(size=1 << 18).astype(np.float32), rng.normal(size=(1 << 18, FACTORS)).astype(np.float32))
    slow = []
    for r in range(3):
        at = np.flatnonzero(x.row == r)
        total = 0.1 + sum(machine.linear[x.bin[i]] * x.weight[i] for i in at)
        total += sum(machine.factors[x.bin[i]] @ machine.factors[x.bin[j]] * x.weight[i] * x.weight[j] for n, i in enumerate(at) for j in at[:n])
        slow.append(total)
    assert np.allclose(machine.logits(x), slow, rtol=1e-3, atol=1e-3)
    assert train(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0)).bias == 0.0
    assert isinstance(x, Features)
