from glob import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import INT64, value
from tidemark.operators.resolve import latest_wins
from tidemark.sources import datasource
from tidemark.sources.datasource import KvReader, register
from tidemark.sources.store import KvStore, rows_of
from tidemark.streaming.ingest import ingest, latest_values
from tidemark.streaming.windows import sessions, tumbling


def write(spark, path, *rows):
    spark.createDataFrame(rows, "k string, seq long, deleted boolean, v double").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("k string, seq long, deleted boolean, v double").option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_is_once_per_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), KvStore.open(spark, str(tmp_path / "s"))
    write(spark, source, ("a", 0, False, 1.0), ("b", 1, False, 2.0))
    changes = lambda: stream(spark, source).select("k", F.col("seq").alias("ordinal"), F.when(~F.col("deleted"), value(INT64, F.col("v").cast("long"))).alias("v"))
    ingest(changes(), store, str(tmp_path / "c")).awaitTermination()
    write(spark, source, ("a", 2, True, None), ("c", 3, False, 3.0))
    ingest(changes(), store, str(tmp_path / "c")).awaitTermination()
    assert rows_of(store.scan_all()) == [("b", 2), ("c", 3)]
    before = store.manifests.read().next_seq
    # the same batches once more, as after a lost checkpoint
    ingest(changes(), store, str(tmp_path / "c2")).awaitTermination()
    assert store.manifests.read().next_seq == before


def test_late_versions_lose(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, ("a", 5, False, 1.0), ("b", 6, False, 2.0))
    out = str(tmp_path / "out")

    def save(rows, number):
        rows.write.mode("append").parquet(out)

    def run():
        latest_values(stream(spark, source)).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    write(spark, source, ("a", 3, False, 9.0), ("b", 7, True, 0.0))
    run()
    got = spark.read.parquet(out)
    assert {(r["k"], r["seq"]) for r in got.collect()} == {("a", 5), ("b", 6), ("b", 7)}
    assert [(r["k"], r["v"]) for r in latest_wins(got).collect()] == [("a", 1.0)]


def test_windows(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 5), ("u", 20), ("w", 3)], "k string, t long").withColumn("at", F.timestamp_seconds("t"))
    assert sorted((r["k"], r["n"]) for r in sessions(rows, "k", "at", 10).collect()) == [("u", 1), ("u", 2), ("w", 1)]
    assert sorted(r["n"] for r in tumbling(rows, "at", 10).collect()) == [1, 3]


def test_a_gap_of_full_length_ends_a_session(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 10_000_000), ("w", 0), ("w", 9_999_999), ("x", 0), ("x", 10_000_001)], "k string, t long").withColumn("at", F.timestamp_micros("t"))
    got = sessions(rows, "k", "at", 10).select("k", F.unix_micros("began"), F.unix_micros("ended"), "n").collect()
    assert sorted(map(tuple, got)) == [("u", 0, 10_000_000, 1), ("u", 10_000_000, 20_000_000, 1), ("w", 0, 19_999_999, 2), ("x", 0, 10_000_000, 1), ("x", 10_000_001, 20_000_001, 1)]


def test_data_source(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"))
    store.batch_put([("a1", 1), ("a2", "x"), ("b", b"y")])
    store.flush()
    store.put("a1", 5)
    store.flush()
    register(spark)
    read = spark.read.format("tidemark").option("path", str(tmp_path / "s"))
    assert read.load().count() == 4
    live = latest_wins(read.option("prefix", "a").load()).collect()
    assert sorted((r["k"], r["i"], r["s"]) for r in live) == [("a1", 5, None), ("a2", None, "x")]


@pytest.mark.parametrize("prefix", ["", "k0", "k7", "none"])
def test_data_source_tasks_are_bounded(spark, tmp_path, monkeypatch, prefix):
    store, path = KvStore.open(spark, str(tmp_path / "s")), str(tmp_path / "s")
    changes = spark.range(1000).select(F.format_string("k%03d", "id").alias("k"), F.col("id").alias("ordinal"), value(INT64, F.col("id")).alias("v"))
    store.append(changes.coalesce(1))
    store.flush()
    # a segment of a file with one row group and one with many
    store.append(changes.repartitionByRange(2, "k"))
    want = [(r["k"], r["seq"], r["deleted"], r["v"]["i"]) for r in store.versions().filter(F.col("k").startswith(prefix)).collect()]
    segment = store.manifests.read().segments[0].split(":", 1)[1]
    file = sorted(glob(f"{path}/{segment}/*.parquet"))[0]
    pq.write_table(pq.read_table(file), file, row_group_size=70)
    monkeypatch.setattr(datasource, "ROWS", 100, raising=False)
    reader = KvReader({"path": path, "prefix": prefix})
    found = [[r for batch in reader.read(p) for r in batch.select(["k", "seq", "deleted", "i"]).to_pylist()] for p in reader.partitions()]
    assert max(map(len, found), default=0) <= 100
    assert sorted(tuple(r.values()) for rows in found for r in rows) == sorted(want)
    # row groups that can't hold the prefix are left out
    assert len(found) == 0 if prefix == "none" else not prefix or len(found) < len(KvReader({"path": path}).partitions())
    # small parts are read together
    monkeypatch.setattr(datasource, "ROWS", 1100)
    assert len(reader.partitions()) == (0 if prefix == "none" else 2)


def test_data_source_tasks_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    store, path = KvStore.open(spark, str(tmp_path / "s")), str(tmp_path / "s")
    store.batch_put([(f"k{i}", f"{i:05d}" * 200) for i in range(100)])
    monkeypatch.setattr(datasource, "BYTES", 10_000, raising=False)
    reader = KvReader({"path": path})
    found = [sum(batch.num_rows for batch in reader.read(p)) for p in reader.partitions()]
    assert sum(found) == 100 and max(found) <= 10


def test_data_source_without_a_run_fails(spark, tmp_path):
    store, path = KvStore.open(spark, str(tmp_path / "s")), str(tmp_path / "s")
    store.batch_put([("a", 1)])
    store.flush()
    store.files.remove(store.manifests.read().runs[0].path)
    with pytest.raises(FileNotFoundError):
        [list(KvReader({"path": path}).read(p)) for p in KvReader({"path": path}).partitions()]
