"""Compaction planners over a manifest frame, and the partitioning of merged rows.

A manifest has a row for each run: run_id, level, entry_count, file_size, smallest_key, largest_key, created_at (seconds).
Planners are aggregations over it, so they are as lazy as any query; it has one row a run and is small beside the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE_BUCKET, WINDOW_SECONDS, MIN_GROUP = 1 << 20, 3600, 4


@dataclass(frozen=True)
class LevelPolicy:
    max_l0_files: int = 10
    target_size: int = 64 << 20
    multiplier: float = 10.0
    levels: int = 7


def leveled_trigger(manifest: DataFrame, policy: LevelPolicy = LevelPolicy()) -> DataFrame:
    """(level, files, bytes, due): level 0 by its number of files, others by their bytes."""
    per = manifest.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"))
    limit = F.lit(float(policy.target_size)) * F.pow(F.lit(policy.multiplier), F.col("level").cast("double"))
    return per.withColumn("due", F.when(F.col("level") == 0, F.col("files") > policy.max_l0_files).otherwise(F.col("bytes") > limit))


def size_tiers(manifest: DataFrame, bucket: int = SIZE_BUCKET, least: int = MIN_GROUP) -> DataFrame:
    """(level, tier, files): groups of runs of like size that are large enough to compact."""
    tier = F.floor(F.col("file_size") / bucket).cast("long")
    return manifest.groupBy("level", tier.alias("tier")).agg(F.count("*").alias("files")).filter(F.col("files") >= least)


def size_tier_select(manifest: DataFrame, bucket: int = SIZE_BUCKET, least: int = MIN_GROUP) -> DataFrame:
    """The runs of each level's fullest tier; of equally full ones the smallest sizes."""
    best = size_tiers(manifest, bucket, least).groupBy("level").agg(F.max(F.struct("files", (-F.col("tier")).alias("neg"))).alias("m")).select("level", (-F.col("m.neg")).alias("tier"))
    return manifest.withColumn("tier", F.floor(F.col("file_size") / bucket).cast("long")).join(best, ["level", "tier"], "left_semi")


def time_windows(manifest: DataFrame, seconds: int = WINDOW_SECONDS, least: int = 2) -> DataFrame:
    """(window, files): tumbling windows of creation times with ``least`` runs or more."""
    window = F.floor(F.col("created_at") / seconds).cast("long")
    return manifest.groupBy(window.alias("window")).agg(F.count("*").alias("files")).filter(F.col("files") >= least)


def time_window_select(manifest: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The runs of the fullest window; of equally full ones the earliest."""
    best = time_windows(manifest, seconds).orderBy(F.desc("files"), "window").limit(1).select("window")
    return manifest.withColumn("window", F.floor(F.col("created_at") / seconds).cast("long")).join(best, "window", "left_semi")


def should_compact(manifest: DataFrame, strategy: str, policy: LevelPolicy = LevelPolicy()) -> list[int]:
    """Levels that are due, in order. leveled, size_tiered, time_windowed, or hybrid: leveled at 0 and by size above."""
    leveled = lambda: [r[0] for r in leveled_trigger(manifest, policy).filter("due").select("level").orderBy("level").collect()]
    tiered = lambda: [r[0] for r in size_tiers(manifest).select("level").distinct().orderBy("level").collect()]
    if strategy == "leveled":
        return leveled()
    if strategy == "size_tiered":
        return tiered()
    if strategy == "time_windowed":
        chosen = time_window_select(manifest).select("level").distinct().orderBy("level").collect()
        return [r[0] for r in chosen]
    if strategy == "hybrid":
        return [x for x in leveled() if x == 0] + [x for x in tiered() if x > 0]
    raise ValueError(f"unknown strategy {strategy!r}")


def entry_bytes(key: Column, value_size: Column) -> Column:
    """What a row is taken to need in a run: its key twice (row and index), its value, and a fixed part."""
    return 2 * F.octet_length(key).cast("long") + value_size.cast("long") + 64


def greedy_pack(sizes: Column, target: int) -> Column:
    """Bin of each element of an array of sizes, in order: a bin closes when the next element would pass the target.

    One fold over the array, for plans over manifests; data is split by ``target_partitions``.
    """
    start = F.struct(F.lit(0).cast("long").alias("fill"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["fill"] > 0) & (a["fill"] + x > target)
        number = a["bin"] + full.cast("int")
        return F.struct((F.when(full, x).otherwise(a["fill"] + x)).cast("long").alias("fill"), number.alias("bin"), F.array_append(a["out"], number).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def target_partitions(total_bytes: int, target: int) -> int:
    return max(1, -(-total_bytes // target))


def safe_to_drop(inputs: DataFrame, others: DataFrame) -> bool:
    """Whether no run outside the inputs overlaps their key range, so that their tombstones have nothing left to hide."""
    ends = inputs.agg(F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi")).first()
    if ends["lo"] is None:
        return True
    return not others.filter((F.col("smallest_key") <= ends["hi"]) & (F.col("largest_key") >= ends["lo"])).take(1)


def compaction_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: entries processed and removed, bytes read, written and reclaimed."""
    total = lambda df, tag: df.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).cast("long").alias(f"n_{tag}"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias(f"b_{tag}"), F.lit(1).alias("one"))
    both = total(before, "in").join(total(after, "out"), "one")
    return both.select(F.col("n_in").alias("processed"), (F.col("n_in") - F.col("n_out")).alias("removed"), F.col("b_in").alias("bytes_read"), F.col("b_out").alias("bytes_written"), F.greatest(F.col("b_in") - F.col("b_out"), F.lit(0)).alias("bytes_reclaimed"))


def sort_leveled(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("largest_key", "smallest_key")
