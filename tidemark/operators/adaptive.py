"""Adaptive compaction policy: scalar decisions over workload rows as CASE expressions.

Fixed values: the ratios and factors below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY, MIXED = 0.7, 0.3
WRITE_AMPLIFICATION, READ_P99_MS, UTILISATION, SENSITIVITY = 2.0, 10.0, 0.8, 0.5
MULTIPLIER = {"WriteHeavy": 1.2, "ReadHeavy": 0.8, "Mixed": 1.05}
MAX_RUNS = {"WriteHeavy": 1.5, "ReadHeavy": 0.7, "Mixed": 1.1}
RATIO = {"WriteHeavy": 1.5, "ReadHeavy": 0.7, "Mixed": 1.1}
BASE_RATIO = 0.1
DEEPEST = {"ReadHeavy": 3, "Mixed": 5}
WORKLOADS_KEPT, METRICS_KEPT = 10, 20


def _per_workload(workload: Column, cases: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for name, x in cases.items():
        out = F.when(workload == name, x).otherwise(out)
    return out


def workload(writes: Column, reads: Column) -> Column:
    total = writes + reads
    w, r = F.try_divide(writes.cast("double"), total.cast("double")), F.try_divide(reads.cast("double"), total.cast("double"))
    return F.when(total == 0, "Unknown").when(w > HEAVY, "WriteHeavy").when(r > HEAVY, "ReadHeavy").when((w > MIXED) & (r > MIXED), "Mixed").otherwise("Unknown")


def strategy(kind: Column, amplification: Column, p99_ms: Column, base: Column | str = "leveled", enabled: bool = True) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    if not enabled:
        return base
    writes = F.when(amplification > WRITE_AMPLIFICATION, "size_tiered").otherwise("leveled")
    reads = F.when(p99_ms > READ_P99_MS, "leveled").otherwise("hybrid")
    return F.when(kind == "WriteHeavy", writes).when(kind == "ReadHeavy", reads).when(kind == "Mixed", "hybrid").otherwise(base)


def priority(kind: Column, amplification: Column, p99_ms: Column, measured_amplification: Column, base: str = "balanced", enabled: bool = True) -> Column:
    if not enabled:
        return F.lit(base)
    writes = F.when(amplification > WRITE_AMPLIFICATION, "write_optimized").otherwise("balanced")
    reads = F.when(p99_ms > READ_P99_MS, "read_optimized").otherwise("balanced")
    return F.when(kind == "WriteHeavy", writes).when(kind == "ReadHeavy", reads).when(measured_amplification > WRITE_AMPLIFICATION, "space_optimized").otherwise("balanced")


def should_schedule(resources: Column, cpu: Column, io: Column, aware: bool = True) -> Column:
    return (F.greatest(resources, cpu, io) <= UTILISATION) if aware else F.lit(True)


def multiplier(kind: Column, amplification: Column, p99_ms: Column) -> Column:
    raw = _per_workload(kind, MULTIPLIER, 1.0) * F.when(amplification > WRITE_AMPLIFICATION, 1.1).otherwise(1.0) * F.when(p99_ms > READ_P99_MS, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1.0 + (raw - 1.0) * SENSITIVITY))


def max_runs(kind: Column, base: Column) -> Column:
    return (base.cast("double") * _per_workload(kind, MAX_RUNS, 1.0)).cast("long")


def compaction_ratio(kind: Column) -> Column:
    return F.lit(BASE_RATIO) * _per_workload(kind, RATIO, 1.0)


def level_enabled(kind: Column, level: Column) -> Column:
    return F.when(level == 0, True).otherwise(level <= _per_workload(kind, DEEPEST, 1 << 30))


def level_config(rows: DataFrame, levels: int, base_multiplier: float = 10.0, base_runs: int = 10) -> DataFrame:
    """Each row (workload, amplification, p99_ms) for each level, with the four level parameters."""
    spine = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    kind = F.col("workload")
    return spine.select("*", (F.lit(base_multiplier) * multiplier(kind, F.col("amplification"), F.col("p99_ms"))).alias("size_multiplier"), max_runs(kind, F.lit(base_runs)).alias("max_runs"), compaction_ratio(kind).alias("compaction_ratio"), level_enabled(kind, F.col("level")).alias("enabled"))


def history(rows: DataFrame, by: list[str], order: str, measure: str, kept: int = WORKLOADS_KEPT) -> DataFrame:
    """Count, mean and greatest of the last ``kept`` entries at each row, and the p99 that is taken as twice the mean."""
    last = Window.partitionBy(*by).orderBy(order).rowsBetween(-(kept - 1), 0)
    return rows.select(*by, order, F.count("*").over(last).alias("n"), F.avg(measure).over(last).alias("mean"), F.max(measure).over(last).alias("most"), (2 * F.avg(measure).over(last)).alias("p99"))
