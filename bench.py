"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed, with its rows written to the noop sink, so all columns of all rows are
made. The store's phases (bulk load and flush, 50,000 gets as one join, prefix scan, counts, compaction) are timed once, cold:
over the line items (``store_*``), and over 5,150,000 rows of 24-byte hexadecimal keys and 150-byte values (``slo_*``).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import FLOAT64, STRING, value
from tidemark.plans.registry import QUERIES
from tidemark.sources.store import KvStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "live_state", "live_lines", "multi_get_orders", "batch_get", "scan_prefix", "scan_range_succ", "scan_range_limit", "snapshot_as_of",
    "union_layers", "put_effects", "live_count_running", "compaction_stats", "key_to_run_range_join", "cf_scan", "counts", "level_rollup",
    "nearest_rank_p99", "alerts", "gap_sessions",
)


def timed(spark: SparkSession, name: str) -> float:
    run = lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run()
    began = time.time()
    run()
    return round(time.time() - began, 3)


def store_phases(spark: SparkSession, name: str, changes: DataFrame, prefix: str) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="bench-")
    took, last = {}, time.time()

    def lap(phase: str) -> None:
        nonlocal last
        took[f"{name}_{phase}"], last = round(time.time() - last, 3), time.time()

    try:
        store = KvStore.open(spark, folder)
        store.append(changes)
        store.flush()
        lap("bulk_load")
        asked = changes.select("k").limit(50_000).withColumn("pos", F.monotonically_increasing_id())
        store.batch_get_frame(asked).write.format("noop").mode("overwrite").save()
        lap("get_50k")
        store.scan_prefix_with_values(prefix).write.format("noop").mode("overwrite").save()
        lap("prefix_scan")
        store.count()
        lap("count")
        store.approx_count()
        lap("approx_count")
        store.append(changes.filter(F.pmod(F.xxhash64("k"), F.lit(10)) == 0))
        store.compact()
        lap("compact")
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return took


def lines(spark: SparkSession) -> DataFrame:
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    return rows.select(F.format_string("li:%08d:%d", "l_orderkey", "l_linenumber").alias("k"), F.monotonically_increasing_id().alias("ordinal"), value(FLOAT64, F.col("l_extendedprice")).alias("v"))


def chunks(spark: SparkSession, rows: int = 5_150_000) -> DataFrame:
    digest = F.md5(F.col("id").cast("string"))
    return spark.range(rows).select(F.substring(digest, 1, 24).alias("k"), F.col("id").alias("ordinal"), value(STRING, F.rpad(digest, 150, "x")).alias("v"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {name: timed(spark, name) for name in HEADLINE}
    took |= store_phases(spark, "store", lines(spark), "li:0000")
    took |= store_phases(spark, "slo", chunks(spark), "00")
    try:
        from tidemark.llm.registry import QUERIES as corpus
    except ModuleNotFoundError:
        corpus = {}
    for name, run in corpus.items():
        began = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
