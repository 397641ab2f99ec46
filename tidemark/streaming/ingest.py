"""Streams into the store, and latest-value state kept by a stream.

Micro-batches are the group commit: one changelog segment and one manifest commit for each, whatever its size. The commit
names the stream and the batch, so a batch that is run again after a failure, wherever that was, is recognised and left out.
Versions arriving late lose by their seq.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.resolve import merge_layers, newest
from tidemark.sources.files import scratch_folder
from tidemark.sources.store import KvStore

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(changes: DataFrame, store: KvStore, checkpoint: str, name: str = "ingest", trigger: dict[str, Any] | None = None, compact_every: int = 0) -> StreamingQuery:
    """Appends a stream of changes (k, ordinal, v, ...) to a store, each micro-batch once."""

    def batch(rows: DataFrame, number: int) -> None:
        store.append(rows, stream=(name, number))
        if compact_every and number % compact_every == compact_every - 1:
            store.flush()
            store.compact_if_needed()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class LatestValue(StatefulProcessor):
    """Keeps a key's newest (seq, deleted, v) and emits each change that is newer than what it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "seq long, deleted boolean, v double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        best = self.newest.get() if self.newest.exists() else None
        was = best
        for frame in rows:
            top = frame.loc[frame["seq"].idxmax()]
            if best is None or int(top["seq"]) > best[0]:
                best = (int(top["seq"]), bool(top["deleted"]), float(top["v"]))
        if best is not None and best is not was:
            self.newest.update(best)
            yield pd.DataFrame({"k": [key[0]], "seq": [best[0]], "deleted": [best[1]], "v": [best[2]]})

    def close(self) -> None:
        pass


def latest_values(changes: DataFrame) -> DataFrame:
    """A stream of changes (k, seq, deleted, v) as the stream of winning versions; late ones are dropped by seq."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return changes.groupBy("k").transformWithStateInPandas(LatestValue(), "k string, seq long, deleted boolean, v double", "update", "None")


def streamed_state(spark: SparkSession, events: str) -> DataFrame:
    """The live state of the events changelog, read as a stream in micro-batches and resolved into one table a batch."""
    schema = spark.read.parquet(events).schema
    parent, _, file = events.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(parent) if not _is_folder(spark, events) else spark.readStream.schema(schema).parquet(events)
    changes = source.select(F.format_string("user:%06d", "user_id").alias("k"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), F.col("value").alias("v"))
    own = scratch_folder(spark, "streamed")
    tables: list[DataFrame] = []

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{own}/state-{number}"
        newest(merge_layers(*tables[-1:], rows)).write.mode("overwrite").parquet(path)
        tables.append(spark.read.parquet(path))

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tables[-1].filter(~F.col("deleted")).select("k", "v", "seq")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
