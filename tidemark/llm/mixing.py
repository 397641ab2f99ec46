"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a fixed 48-bit hash of its id and text. A source that should give ``q + f`` times its tokens
(``0 <= f < 1``) gives every document ``q`` times, and once more each document whose hash lies below a threshold at which
the hashes below hold about ``f`` of the tokens. The threshold is found by nested histograms: tokens are summed by source
and the top 12 bits of the hash, a running sum over the bins (never over documents) shows the bin in which the budget
ends, and only that bin's documents are summed again by the next 12 bits. Nothing is sorted, a document's fate depends on
its own hash and its source's threshold only, and a larger budget keeps every document that a smaller one kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hot_keys, n_words, spread_join, written

#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 4


def document_hash(doc_id: Column, text: Column) -> Column:
    """48 bits, the same on every run and in any engine that has md5: the first twelve hex digits of ``id|text``'s md5."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _weighted(sources: DataFrame, weights: tuple[int, ...], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sources with the weight of their place in the order of code points, null last.

    They are dealt by ranges of that order; a source's place is that in its range and the number of sources in the ranges
    before, of which the driver holds one number each. So no task sorts all sources, be they as many as domains.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = keep(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    start = F.element_at(F.array(*map(F.lit, before or [0])), F.col("range") + 1)
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + start
    return dealt.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def targets(sources: DataFrame, cap: int = 3, weights: tuple[int, ...] = (5, 2, 1), keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Targets from (source, source_size): shares of the whole by weight, none above ``cap`` times its source's size.

    What capped sources leave is reshared among the others by weight, which can bring more of them to their caps; that is
    done again until none is added. Each time is one aggregation over the sources to two numbers. ``keep`` writes a table.
    """
    ranked = keep(_weighted(sources, weights, keep).withColumn("cap", F.lit(cap) * F.col("source_size")))
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, shares, capped = whole[0] or 0, whole[1] or 1, 0
    exact = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")
    while True:
        above = exact(F.col("cap")) * exact(shares) < exact(F.col("weight")) * exact(rest)
        found = ranked.filter(above).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if found[0] == capped:
            break
        capped, rest, shares = found[0], whole[0] - found[1], whole[1] - found[2]
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(shares))
    return ranked.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _digit(level: int) -> Column:
    return F.shiftright("hash", BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix_sources(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (5, 2, 1), keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target and taken (words the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own, weighed last; a null id counts as empty in the hash.
    Rows that agree in id and text share a hash and are taken or left together. Of the bin that still straddles the budget
    after the last histogram (one hash value), the nearer side is chosen. Empty input gives no rows. ``keep`` names input
    columns to return besides.
    """
    # a null source is a key like any other
    key = lambda df: df.withColumns({"_s": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    sized = written(docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"), n_words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"), *(F.col(x).alias(f"_{x}") for x in keep)))
    # the documents of large sources are joined in parts
    named = ["_s", "_none"]
    hot = named, hot_keys(sized, named)
    with Scratch(docs.sparkSession) as tables:
        sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = targets(sums, cap, weights, tables)
        # at a cap the quotient is whole and nothing is left over
        budget = F.when(F.col("source_size") > 0, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).otherwise(0.0)
        plan = written(plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", budget))
        found = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
        for level in range(LEVELS):
            high = F.shiftright("hash", BITS * (LEVELS - level))
            edge = key(found).select(*named, "prefix", "left")
            bins = spread_join(sized.withColumn("prefix", high), edge, [*named, "prefix"], ["hash"], "inner", hot).groupBy("source", "prefix", "left", _digit(level).alias("digit")).agg(F.sum("size").alias("n"))
            run = Window.partitionBy("source").orderBy("digit")
            bins = bins.withColumn("upto", F.sum("n").over(run))
            last = level == LEVELS - 1
            # the first bin with which the budget is passed; at the last level the nearer side of it
            stop = (F.col("upto") - F.col("left") > F.col("left") - (F.col("upto") - F.col("n"))) if last else F.col("upto") > F.col("left")
            full = Window.partitionBy("source")
            edges = bins.withColumn("bin", F.min(F.when(stop, F.col("digit"))).over(full)).groupBy("source", "prefix", "left").agg(F.first("bin").alias("bin"), F.coalesce(F.sum(F.when(F.col("digit") < F.col("bin"), F.col("n"))), F.lit(0)).alias("below"))
            # no bin passes it: everything under this prefix is taken
            found = tables(edges.select("source", (F.col("prefix") * (1 << BITS) + F.coalesce("bin", F.lit(1 << BITS))).alias("prefix"), F.when(F.col("bin").isNotNull(), F.col("left") - F.col("below")).otherwise(0.0).alias("left"), F.col("bin").isNull().alias("all")))
            if level == 0:
                done = found.filter("all").select("source", (F.col("prefix") * (1 << BITS * (LEVELS - 1))).alias("threshold"))
            else:
                done = done.unionByName(found.filter("all").select("source", (F.col("prefix") * (1 << BITS * (LEVELS - 1 - level))).alias("threshold")))
            found = found.filter("not all").drop("all")
        done = written(done.unionByName(found.select("source", F.col("prefix").alias("threshold"))))
    terms = key(plan).join(key(done).drop("source"), named, "left").select(*named, "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    taken = F.col("size") * (F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0))
    out = spread_join(sized, terms, named, ["hash"], "inner", hot)
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"_{x}").alias(x) for x in keep))


def op2_mixing(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same thresholds by a running sum over single documents.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
r AS (SELECT *, row_number() OVER o AS nth,
             CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weights
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
f AS (SELECT nth, rest, weights FROM r WHERE cap * weights >= weight * rest ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN r.nth >= f.nth THEN CAST(weight * f.rest AS DOUBLE) / CAST(f.weights AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
      FROM r, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
h AS (SELECT source, hash, sum(size) AS n FROM d GROUP BY source, hash),
c AS (SELECT h.*, sum(n) OVER (PARTITION BY h.source ORDER BY hash) AS upto, target - copies * source_size AS budget
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
m AS (SELECT source, min(CASE WHEN upto - budget > budget - (upto - n) THEN hash END) AS threshold FROM c GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.copies + CASE WHEN m.threshold IS NULL OR d.hash < m.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""
