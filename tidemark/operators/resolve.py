"""Versions to state: the newest version of a key wins, and a tombstone that wins hides it.

A versioned frame has the columns k, seq and deleted, and a payload. All of it is one aggregation with partial combination
before the shuffle, so a key with very many versions sends one row from each task; filters on k pass below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("k", "seq", "deleted")
#: Seqs that are looked at together where the order of all versions matters.
BLOCK = 100_000


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, T.StructType) or all(_orderable(f.dataType) for f in kind)


def newest(df: DataFrame, as_of: int | None = None, tie: str | None = None) -> DataFrame:
    """The winning version of every key, tombstones included: the greatest seq, then the greatest ``tie``.

    Without ``tie`` equal seqs are settled by the rest of the row, so that the result doesn't depend on the order of rows.
    """
    if as_of is not None:
        df = df.filter(F.col("seq") <= as_of)
    rest = [c for c in df.columns if c not in ("k", "seq")]
    first = ["seq", *([tie] if tie else [])]
    if all(_orderable(df.schema[c].dataType) for c in rest):
        win = F.max(F.struct(*first, *(c for c in rest if c != tie)))
    else:
        win = F.max_by(F.struct("seq", *rest), F.struct(*first))
    return df.groupBy("k").agg(win.alias("_w")).select(*(F.col("k") if c == "k" else F.col(f"_w.{c}").alias(c) for c in df.columns))


def latest_wins(df: DataFrame, as_of: int | None = None, tie: str | None = None) -> DataFrame:
    """The live rows, without the column deleted."""
    return newest(df, as_of, tie).filter(~F.col("deleted")).drop("deleted")


def latest_wins_ranked(df: DataFrame, as_of: int | None = None) -> DataFrame:
    """The same by a window, whose partial top-1 keeps wide payloads out of the aggregation buffers."""
    if as_of is not None:
        df = df.filter(F.col("seq") <= as_of)
    order = Window.partitionBy("k").orderBy(F.col("seq").desc())
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1 AND NOT deleted").drop("_n", "deleted")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Rows of all layers; which of them win is a matter of their seq, not of the order of layers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def apply_layer(state: DataFrame, layer: DataFrame) -> DataFrame:
    """``state`` (k and payload) overwritten by a newer layer (k, deleted and payload)."""
    puts = layer.filter(~F.col("deleted")).drop("deleted")
    return state.join(layer.select("k"), "k", "left_anti").unionByName(puts.select(state.columns))


def put_effects(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each version with ``effect``: Inserted, UpdatedLive, Resurrected or Tombstone, and ``delta``, its change of the count.

    What was before is looked for among the versions of a key in the same block of seqs; only a block's first version of a
    key asks for the key's last version in an earlier block, of which there is one row a key and block. So a key that has a
    large part of all versions is sorted in pieces, not in one task.
    """
    at = df.withColumn("_b", F.floor(F.col("seq") / block))
    near = F.lag("deleted").over(Window.partitionBy("k", "_b").orderBy("seq"))
    ends = at.groupBy("k", "_b").agg(F.max_by("deleted", "seq").alias("_last"))
    ends = ends.select(F.col("k").alias("_k"), F.col("_b").alias("_of"), F.lag("_last").over(Window.partitionBy("k").orderBy("_b")).alias("_far"))
    met = at.withColumn("_near", near).join(ends, F.col("k").eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_of")), "left")
    before = F.coalesce("_near", "_far")
    effect = F.when(F.col("deleted"), "Tombstone").when(before.isNull(), "Inserted").when(before, "Resurrected").otherwise("UpdatedLive")
    live = F.coalesce(~before, F.lit(False)).cast("int")
    out = met.withColumn("effect", effect).withColumn("delta", F.when(F.col("deleted"), -live).otherwise(1 - live).cast("long"))
    return out.select(*df.columns, "effect", "delta")


def live_count_running(df: DataFrame, block: int = BLOCK, fan: int = 1000) -> DataFrame:
    """(seq, live): the number of live keys after each version.

    The running sum is over groups of ``fan`` blocks first, then over a group's blocks, then within a block, so no task
    sorts more than a block of the log or a group of blocks; the one task over groups has a row for every ``block * fan`` seqs.
    """
    steps = put_effects(df, block).select("seq", F.floor(F.col("seq") / block).alias("_b"), "delta")
    blocks = steps.groupBy("_b").agg(F.sum("delta").alias("n")).withColumn("_g", F.floor(F.col("_b") / fan))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = blocks.groupBy("_g").agg(F.sum("n").alias("n")).select("_g", upto(Window.orderBy("_g")).alias("far"))
    before = blocks.withColumn("near", upto(Window.partitionBy("_g").orderBy("_b"))).join(groups, "_g").select("_b", (F.col("near") + F.col("far")).alias("base"))
    within = Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(before, "_b").select("seq", (F.col("base") + F.sum("delta").over(within)).cast("long").alias("live"))


def after_checkpoint(log: DataFrame, is_checkpoint: Column) -> DataFrame:
    """The part of a log after its last checkpoint (all of it if there is none), by seq, not by the clock."""
    last = log.filter(is_checkpoint).agg(F.max("seq").alias("seq")).first()["seq"]
    return log if last is None else log.filter(F.col("seq") > last)


def durable_watermark(slots: DataFrame) -> DataFrame:
    """The valid slot (generation, position, data, checksum) of the greatest generation; its checksum is the CRC32 of data.

    Slots are written in turn, so that one of them is whole whenever a write is cut off.
    """
    whole = slots.filter(F.crc32("data") == F.col("checksum"))
    return whole.agg(F.max("generation").alias("generation"), F.max_by("position", "generation").alias("position")).filter("generation IS NOT NULL")


def dedupe_runs(*runs: DataFrame, drop_tombstones: bool) -> DataFrame:
    """Compaction's merge: one version a key; tombstones go only if nothing older can lie below."""
    merged = newest(merge_layers(*runs))
    return merged.filter(~F.col("deleted")) if drop_tombstones else merged


def visible_at(df: DataFrame, now: int) -> DataFrame:
    """Rows that haven't expired at ``now`` (epoch seconds), with the seconds they have left (null: no limit)."""
    left = F.col("expires_at") - F.lit(now)
    return df.filter(F.col("expires_at").isNull() | (left > 0)).withColumn("remaining", left)
