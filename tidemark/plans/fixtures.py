"""Key-value views of the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import latest_wins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of users; an error deletes. Runs are blocks of a thousand events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.format_string("user:%06d", "user_id").alias("k"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).cast("int").alias("run"), (F.col("event_type") == "error").alias("deleted"), F.col("value").alias("v"), "ts", "event_type")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_wins(changelog(spark, sf_dir).select("k", "seq", "deleted", "v", "run"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.format_string("order:%08d", "o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("cf"))


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions; a later ship date (then part, then supplier) is newer."""
    li = table(spark, sf_dir, "lineitem")
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey")
    return li.select(F.format_string("li:%08d:%d", "l_orderkey", "l_linenumber").alias("k"), seq.alias("seq"), F.lit(False).alias("deleted"), F.col("l_extendedprice").alias("v"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the blocks of the changelog: level 1 below block 4, then level 0."""
    c = changelog(spark, sf_dir)
    return c.groupBy("run").agg(F.count("*").alias("entry_count"), F.min("k").alias("smallest_key"), F.max("k").alias("largest_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.min(F.unix_timestamp("ts")).alias("created_at")).select(
        F.col("run").alias("run_id"), F.when(F.col("run") < 4, 1).otherwise(0).alias("level"), "entry_count", (F.col("entry_count") * 100).alias("file_size"), "smallest_key", "largest_key", "min_seq", "max_seq", "created_at")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with narrow ranges: blocks of 1500 order keys of the line items."""
    li = table(spark, sf_dir, "lineitem")
    k = F.format_string("order:%08d", "l_orderkey")
    return li.groupBy(F.floor(F.col("l_orderkey") / 1500).cast("int").alias("run_id")).agg(F.min(k).alias("smallest_key"), F.max(k).alias("largest_key"))


def user_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: views as reads, the rest as writes."""
    e = table(spark, sf_dir, "events")
    reads = F.count_if(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(reads.alias("reads"), (F.count("*") - reads).alias("writes"), F.avg("value").alias("mean_value"), F.max("value").alias("most_value"))


def ordinal(by: str):
    return F.row_number().over(Window.orderBy(by))
