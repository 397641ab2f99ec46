"""Windows over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """(by, began, ended, n): events less than ``gap_seconds`` apart. A stream needs a watermark first."""
    # a session window takes in an event at its end too, so it ends a microsecond, the least step of a timestamp, earlier
    window = F.session_window(at, f"{gap_seconds * 1_000_000 - 1} microseconds")
    ended = F.col("w.end") + F.expr("INTERVAL '0.000001' SECOND")
    return rows.groupBy(by, window.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("began"), ended.alias("ended"), "n")


def tumbling(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """(began, n) for windows of ``seconds``."""
    return rows.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "n")
