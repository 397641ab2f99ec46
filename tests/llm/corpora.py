"""Small corpora with the odd cases that every operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators use inside.
CLASHING = {"hi": "1", "lo": "2", "drop": "'x'", "runs": "3", "sid": "4", "component": "5", "score": "0.5", "hash": "6", "size": "7", "bucket": "8", "k": "'k'", "c0": "9", "seq": "10"}
VOCABULARY = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "st", "r", "l", "")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def mixed(seed=0, n=60):
    """Documents with copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    line = sentence(rng, 12)
    passage = sentence(rng, 30)
    base = sentence(rng, 80)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            words = base.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY).upper()
            text = " ".join(words)
        elif kind == 2:
            text = "\n".join([sentence(rng, 20), f"  {line.upper()}\t", sentence(rng, 9), line])
        elif kind == 3:
            text = f"{sentence(rng, rng.randrange(30))} {passage}\n{sentence(rng, rng.randrange(30))}"
        elif kind == 4:
            text = sentence(rng, rng.randrange(8))
        else:
            text = " ".join([rng.choice(VOCABULARY)] * rng.randrange(20, 60))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    return rows


def odd():
    """Null ids and texts, empty and blank texts, a repeated row, a long text, other scripts, no final newline."""
    rng = random.Random(9)
    long_ = sentence(rng, 30_000)
    rows = [(100, None, None, None, None), (101, "", "en", None, 0), (102, " \t\n\x0b ", "en", "s1", 5), (None, sentence(rng, 40), "en", "s2", 9), (None, None, None, None, None)]
    rows += [(103, long_, "en", "s3", len(long_)), (104, "één ÉÉN 日本 語\n\nx\n", "fr", "s0", 20), (105, "a b a b a b\n", "en", "s0", 12)]
    return rows + [(106, sentence(random.Random(3), 60), "en", "s1", 1)] * 2


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for name, x in CLASHING.items():
            df = df.withColumn(name, F.expr(x))
    return df
