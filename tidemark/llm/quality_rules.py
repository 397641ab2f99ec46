"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured, and a few rules are judged on the measures. For each host (here the document's source) and each
rule the failures are summed, and the host's rate is shrunk towards the rate of all hosts by a beta prior fitted to the
hosts' own rates (beta-binomial moments: the spread that sampling alone would give is taken off), so that a host of few
documents needs the more evidence the less hosts really differ. A host is *suspect* if the shrunk rate of some rule is above
``LIMIT``. A document goes if it fails a base rule, or if its host is suspect and it fails any rule itself; clean documents of
a suspect host stay.

Defined cases: a null text is empty, so it has no words and fails; a null source is a host of its own; rows that repeat a
doc_id are judged one by one; without rows there are no hosts and no prior, and the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, spread_join, written

LIMIT = 0.5
#: Bounds on the prior's weight, in documents. The most stands where hosts don't differ. The least is for corpora of few hosts,
#: where the moments say little: it keeps a host's single document from making the host suspect.
LEAST_WEIGHT, MOST_WEIGHT = 5.0, 1e6
SYMBOLS = "#*$%&|<>"
#: Rule: SQL condition under which a document fails it. The first two are the base rules.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE = ("few_words", "repeats")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column, frame: DataFrame) -> DataFrame:
    """``frame`` with the measures of ``text``. Repeated windows are found by sorting a document's window hashes."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    at = frame.select("*", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_w"), lines.alias("_l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    word = lambda i: F.get("_w", i)
    hashes = F.when(F.size("_w") >= 4, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    at = at.select("*", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), hashes.alias("_h"))
    # most documents repeat no window, which a set of their hashes tells without sorting
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    at = at.select("*", F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_g"))
    near = lambda k: F.get("_g", k)["h"]
    again = F.filter("_g", lambda x, k: ((k > 0) & (near(k - 1) == x["h"])) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    at = at.select("*", F.array_sort(F.transform(again, lambda x: x["i"])).alias("_p"))
    # windows in order: each adds the words that the one before did not cover
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return at.select(
        *frame.columns, F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def suspects(judged: DataFrame) -> DataFrame:
    """(host, suspect) from (host, one boolean for each rule)."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    n = F.col("n").cast("double")
    # a few numbers, however many hosts there are
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("total"), F.sum(n * n).alias("squares")]
    for r in RULES:
        sums += [F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_squares")]
    found = hosts.agg(*sums).first()
    bad = F.lit(False)
    for r in RULES:
        mean, weight = prior(found["hosts"], found["total"], found["squares"], found[r], found[f"{r}_squares"])
        bad = bad | ((F.col(r) + mean * weight) / (F.col("n") + weight) > LIMIT)
    return hosts.select("host", bad.alias("suspect"))


def prior(hosts: int, total: float | None, squares: float | None, failed: int | None, failed_squares: float | None) -> tuple[float, float]:
    """Mean and weight of a beta prior by beta-binomial moments.

    Hosts of n documents that all had one rate m would still spread: the sum of n (rate - m)^2 would be m (1 - m) (hosts - 1) from
    sampling alone. What exceeds that is the correlation of documents of one host, 1 / (weight + 1); if nothing does, hosts
    don't differ and the prior decides. The arguments are sums over hosts: of n, n^2, failures, and failures^2 / n.
    """
    if not total:
        return 0.0, MOST_WEIGHT
    mean = failed / total
    room = total - squares / total - (hosts - 1)
    if not 0 < mean < 1 or room <= 0:
        return mean, MOST_WEIGHT
    alike = ((failed_squares - failed * failed / total) / (mean * (1 - mean)) - (hosts - 1)) / room
    return mean, MOST_WEIGHT if alike <= 0 else min(max(1 / alike - 1, LEAST_WEIGHT), MOST_WEIGHT)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for each row of ``docs`` (doc_id, text, source)."""
    slim = docs.select("doc_id", F.col("source").alias("host"), F.col("text").alias("_text"))
    judged = measures(F.col("_text"), slim).drop("_text").select("*", *(F.expr(x).alias(r) for r, x in RULES.items()))
    judged = written(judged)
    verdicts = suspects(judged).withColumnRenamed("host", "_host")
    any_failed, base_failed = F.lit(False), F.lit(False)
    for r in RULES:
        any_failed = any_failed | F.col(r)
    for r in BASE:
        base_failed = base_failed | F.col(r)
    # a null host is a key like any other, and a host of very many documents is joined in parts
    key = lambda df, host: df.withColumns({"_h": F.coalesce(host, F.lit("")), "_none": F.col(host).isNull()})
    out = spread_join(key(judged, "host"), key(verdicts, "_host"), ["_h", "_none"], ["doc_id", *MEASURES], "inner")
    return out.select("doc_id", *MEASURES, base_failed.alias("base_failed"), (~base_failed & ~(F.col("suspect") & any_failed)).alias("kept"))


def op1_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_RULE_SQL = ", ".join(f"({x}) AS {r}" for r, x in RULES.items())
_MEANS_SQL = ", ".join(f"sum({r}) / z.total AS m_{r}" for r in RULES)
_ALIKE_SQL = ", ".join(f"CASE WHEN m_{r} > 0 AND m_{r} < 1 AND room > 0 THEN ((SELECT sum(n * pow({r} / n - m_{r}, 2)) FROM h) / (m_{r} * (1 - m_{r})) - (hosts - 1)) / room ELSE 0 END AS a_{r}" for r in RULES)
_WEIGHT_SQL = ", ".join(f"CASE WHEN a_{r} > 0 THEN least(greatest(1 / a_{r} - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) ELSE {MOST_WEIGHT} END AS w_{r}" for r in RULES)
_BAD_SQL = " OR ".join(f"({r} + m_{r} * w_{r}) / (n + w_{r}) > {LIMIT}" for r in RULES)

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM a WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
j AS (SELECT *, {_RULE_SQL} FROM m),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum(CAST({r} AS BIGINT)) AS {r}" for r in RULES)} FROM j GROUP BY source),
z AS (SELECT sum(n) AS total FROM h),
p AS (SELECT count(*) AS hosts, z.total - sum(n * n) / z.total - (count(*) - 1) AS room, {_MEANS_SQL} FROM h, z GROUP BY z.total),
v AS (SELECT *, {_ALIKE_SQL} FROM p),
q AS (SELECT *, {_WEIGHT_SQL} FROM v),
s AS (SELECT source, ({_BAD_SQL}) AS suspect FROM h, q)
SELECT j.doc_id, {", ".join(f"j.{x}" for x in MEASURES)}, ({" OR ".join(f"j.{r}" for r in BASE)}) AS base_failed,
       NOT ({" OR ".join(f"j.{r}" for r in BASE)}) AND NOT (suspect AND ({" OR ".join(f"j.{r}" for r in RULES)})) AS kept
FROM j JOIN s ON j.source IS NOT DISTINCT FROM s.source
"""
