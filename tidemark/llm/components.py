"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release, spread_join, written


#: Edges up to which a node's neighbours are not worth dealing in parts: one task takes them in seconds.
FEW = 200_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Large: every node links its larger neighbours to its least neighbour; small: its smaller ones, and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u") if few else spread_join(both, least, ["u"], ["v"], "inner")
    out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(node, component) for every node of an edge, the component being its least node. Nodes are longs; ``keep`` writes
    the result.

    Rounds are written to the shared folder; a node with very many neighbours has them dealt in parts. The rounds end when a
    pair of them leaves the edges as they were, which takes a number of rounds logarithmic in the longest path; then every
    edge points at its component.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with Scratch(edges.sparkSession) as tables:
        edges = tables(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
        was = state(edges)
        while True:
            few = was[0] <= FEW
            once = _star(edges, True, few)
            edges = tables(_star(once if few else tables(once), False, few))
            release(edges.sparkSession)
            now = state(edges)
            if now == was:
                break
            was = now
        return keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
