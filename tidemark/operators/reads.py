"""Reads over a resolved view S(k, ...). Every scan comes in key order; see ``keys.range_pred`` for what a range includes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import CF_SEPARATOR, prefix_pred, range_pred, strip_prefix

VISITED_TAGS = (0, 5)


def get(state: DataFrame, key: str) -> DataFrame:
    return state.filter(F.col("k") == key)


def exists(state: DataFrame, key: str) -> bool:
    return bool(get(state, key).select("k").take(1))


def exists_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (k) that are live."""
    return keys.join(state.select("k"), "k", "left_semi")


def missing_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(state.select("k"), "k", "left_anti")


def positions(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(keys)), "pos long, k string")


def batch_get(state: DataFrame, keys: DataFrame, ordered: bool = True) -> DataFrame:
    """Every row of ``keys`` (pos, k) in order, duplicates too, with the columns of ``state``, null where it has no such key.

    Spark picks the join by size: few keys are broadcast to the state, many are shuffled with it.
    """
    out = keys.join(state, "k", "left").select("pos", *state.columns)
    return out.orderBy("pos") if ordered else out


def batch_delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("k"), "k", "left_anti")


def scan_prefix(state: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    return _ordered(state.filter(prefix_pred(F.col("k"), prefix)), limit)


def scan_range(state: DataFrame, start: str = "", end: str = "", limit: int | None = None, end_mode: str = "succ") -> DataFrame:
    return _ordered(state.filter(range_pred(F.col("k"), start, end, end_mode)), limit)


def scan_all(state: DataFrame) -> DataFrame:
    return _ordered(state, None)


def keys(state: DataFrame) -> DataFrame:
    return state.select("k").orderBy("k")


def _ordered(df: DataFrame, limit: int | None) -> DataFrame:
    out = df.orderBy("k")
    return out if limit is None else out.limit(limit)


def scan_next(state: DataFrame, prefix: str, after: str | None = None, limit: int = 1) -> DataFrame:
    """The next ``limit`` pairs under a prefix after a key: keyset pagination, which needs no state between pages."""
    found = state.filter(prefix_pred(F.col("k"), prefix))
    if after is not None:
        found = found.filter(F.col("k") > after)
    return _ordered(found, limit)


class PrefixCursor:
    """Pages under a prefix over one view, which writers and compaction don't move."""

    def __init__(self, state: DataFrame, prefix: str) -> None:
        self.state, self.prefix, self.last, self.eof = state, prefix, None, False

    def next_n(self, n: int) -> tuple[list[Row], bool]:
        """At most ``n`` rows and whether that was the end: fewer rows than asked for (so a full last page says no yet)."""
        if self.eof:
            return [], True
        rows = scan_next(self.state, self.prefix, self.last, n).collect()
        if rows:
            self.last = rows[-1]["k"]
        self.eof = len(rows) < n
        return rows, self.eof

    def next(self) -> Row | None:
        rows, _ = self.next_n(1)
        return rows[0] if rows else None


def iterate(state: DataFrame, start: str = "", end: str = "", end_mode: str = "succ") -> Iterator[Row]:
    """A range row by row; the driver holds one partition at a time."""
    return scan_range(state, start, end, end_mode=end_mode).toLocalIterator()


def for_each(state: DataFrame, prefix: str, visit: Callable[[str, Any], bool], value: str = "v") -> int:
    """Calls ``visit(key, value)`` in key order for text and bytes under a prefix until it returns False; how many it saw."""
    seen = 0
    for row in scan_prefix(state.filter(F.col(value)["tag"].isin(*VISITED_TAGS)), prefix).toLocalIterator():
        seen += 1
        if visit(row["k"], row[value]) is False:
            break
    return seen


def counts(state: DataFrame, prefix: str, start: str, end: str) -> DataFrame:
    """One row: all keys, those under the prefix, those in the range; in one pass."""
    k = F.col("k")
    return state.agg(F.count("*").alias("total"), F.count_if(prefix_pred(k, prefix)).alias("in_prefix"), F.count_if(range_pred(k, start, end)).alias("in_range"))


def count_prefix(state: DataFrame, prefix: str) -> int:
    return state.filter(prefix_pred(F.col("k"), prefix)).count()


def count_range(state: DataFrame, start: str, end: str) -> int:
    return state.filter(range_pred(F.col("k"), start, end)).count()


def in_cf(state: DataFrame, cf: str, prefix: str = "", relative: bool = False) -> DataFrame:
    """The rows of a column family under a prefix, with the family's name cut off (and the prefix too if ``relative``)."""
    full = f"{cf}{CF_SEPARATOR}{prefix}"
    cut = full if relative else f"{cf}{CF_SEPARATOR}"
    return state.filter(prefix_pred(F.col("k"), full)).withColumn("k", strip_prefix(F.col("k"), cut))


def key_to_runs(keys: DataFrame, runs: DataFrame, cells: int = 512) -> DataFrame:
    """(k, run_id): the runs (run_id, smallest_key, largest_key) whose range covers a key.

    The key space is cut into cells at beginnings of runs, so cells follow the runs whatever the keys look like. A key's cell is
    found by halving, in an expression of as many levels as ``cells`` has bits; a run is filed under each cell that it
    reaches. So keys and runs meet by an equi-join with a range check, for which Spark broadcasts the runs if they are small
    enough and shuffles both sides otherwise.
    """
    # as many beginnings as cells need, drawn by hash, whatever the number of runs
    drawn = runs.select("smallest_key").filter("smallest_key IS NOT NULL").distinct().orderBy(F.xxhash64("smallest_key"), "smallest_key").limit(cells - 1)
    cuts = sorted((r[0] for r in drawn.collect()), key=lambda x: x.encode())

    def cell(key: Column, low: int = 0, high: int = len(cuts)) -> Column:
        """The number of cuts that are not above the key."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], cell(key, low, middle)).otherwise(cell(key, middle + 1, high))

    filed = runs.select("run_id", "smallest_key", "largest_key", F.explode(F.sequence(cell(F.col("smallest_key")), cell(F.col("largest_key")))).alias("cell"))
    met = keys.withColumn("cell", cell(F.col("k"))).join(filed.filter("smallest_key <= largest_key"), "cell")
    return met.filter(F.col("k").between(F.col("smallest_key"), F.col("largest_key"))).select("k", "run_id")
