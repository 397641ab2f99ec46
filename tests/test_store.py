"""Scenarios of writes, reads, flushes, compaction, restarts and snapshots, and a random comparison with a dictionary."""

import random
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.errors import ColumnFamilyNotFound, CommitConflict, ConfigError, InvalidKey, InvalidValue, StorageError, Unsupported
from tidemark.functions.values import INT64, value
from tidemark.monitor import AlertRule, Monitor
from tidemark.operators.compaction import LevelPolicy
from tidemark.sources.store import KvStore, rows_of


@pytest.fixture
def store(spark, tmp_path):
    return KvStore.open(spark, str(tmp_path / "s"))


def again(store):
    """The same folder after a crash: what was only pending is lost."""
    return KvStore.open(store.spark, store.files.root, store.config, store.clock)


def test_prefix_and_range(store):
    store.batch_put([("user:1", 1), ("user:2", 2), ("user:3", 3), ("config:debug", True)])
    assert [k for k, _ in rows_of(store.scan_prefix_with_values("user:"))] == ["user:1", "user:2", "user:3"]
    assert len(rows_of(store.scan_range_with_values("user:1", "user:3"))) == 3
    assert rows_of(store.scan_range_with_values("user:2", "user:1")) == []
    assert rows_of(store.scan_range_with_values("user:1", "", limit=2)) == [("user:1", 1), ("user:2", 2)]
    assert [r["k"] for r in store.scan_prefix("user:").collect()] == [r["k"] for r in store.scan_range_limit("user:1", "user:3", 9).collect()] == ["user:1", "user:2", "user:3"]
    assert rows_of(store.scan_next("user:", "user:1")) == [("user:2", 2)] and rows_of(store.scan_range_limit_with_values("a", "z", 1)) == [("config:debug", True)]
    assert store.get("config:debug") is True and store.get("nothing") is None


def test_cursor_and_tombstones(store):
    store.batch_put([("a1", b"1"), ("a2", b"2"), ("a3", b"3"), ("b1", b"4")])
    store.delete("a2")
    store.flush()
    c = store.cursor("a")
    store.put("a9", b"late")
    store.compact()
    assert [(c.next() or {"k": None})["k"] for _ in range(3)] == ["a1", "a3", None]


def test_pages_equal_scan(store):
    store.batch_put([(f"s/{i:02}", i) for i in range(20)])
    c, pages = store.cursor("s/"), []
    while True:
        rows, eof = c.next_n(7)
        pages += [r["k"] for r in rows]
        if eof:
            break
    assert pages == [f"s/{i:02}" for i in range(20)]


def test_counts(store):
    seen = [store.count()]
    store.batch_put([("a", 1), ("b", 2)])
    seen.append(store.count())
    store.put("a", 3)
    seen.append(store.count())
    store.delete("b")
    seen.append(store.count())
    store.flush()
    seen.append(store.count())
    store.put("c", 1)
    seen.append(store.count())
    assert seen == [0, 2, 2, 1, 1, 2]
    store.put("d", None)
    assert store.count() == 2


def test_delete_then_compact(store):
    store.batch_put([(f"k{i:03}", f"v{i}") for i in range(100)])
    store.flush()
    store.batch_delete(f"k{i:03}" for i in range(50))
    done = store.compact()
    assert done["processed"] == 150 and done["removed"] == 100
    assert [k for k, _ in rows_of(store.scan_all())] == [f"k{i:03}" for i in range(50, 100)]


def test_no_resurrection(store):
    store.batch_put([("pad", 0), ("victim", "old")])
    store.flush()
    store.compact()
    store = again(store)
    store.put("victim", "new")
    store.flush()
    store.delete("victim")
    store.flush()
    # merging level 0 alone must keep the tombstone, as level 1 still has the key
    store.compact(levels=[0], to_level=0)
    assert store.get("victim") is None
    store.compact()
    assert store.get("victim") is None
    store.put("victim", "after")
    store.compact()
    assert again(store).get("victim") == "after"


def test_crash_recovery(store):
    store.batch_put([("a", 1)])
    store.put_durable("b", 2)
    store.put("c", 3)
    fresh = again(store)
    assert fresh.batch_get(["a", "b", "c", "b"]) == [1, 2, None, 2]
    fresh.delete("a")
    fresh.sync()
    assert again(fresh).get("a") is None


def test_last_duplicate_wins_and_limits(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(max_batch_size=3))
    store.batch_put([("k", 1), ("k", 2), ("k", 3)])
    assert store.get("k") == 3
    with pytest.raises(InvalidValue):
        store.batch_put([("k", 1)] * 4)
    with pytest.raises(InvalidKey):
        store.put("", 1)
    with pytest.raises(Unsupported):
        store.begin_transaction()
    with pytest.raises(ConfigError):
        Config(strategy="none", flush_rows=0).validate()


def test_families(store):
    store.create_column_family("u")
    store.batch_put_cf([("x1", 1), ("x2", 2), ("x22", 3)], "u")
    store.put("x1", "bare")
    assert store.get_cf("x1", "u") == 1 and store.get("x1") == "bare" and store.get("u#x1") == 1
    assert rows_of(store.scan_prefix_with_values_cf("x2", "u")) == [("x2", 2), ("x22", 3)]
    assert rows_of(store.scan_prefix_with_values_cf("x2", "u", relative=True)) == [("", 2), ("2", 3)]
    assert [k for k, _ in rows_of(store.scan_range_with_values_cf("x1", "x2", "u"))] == ["x1", "x2", "x22"]
    assert [k for k, _ in store.iter_range_cf("x1", "x2", "u")] == ["x1", "x2"]
    assert {r["cf"]: r["keys"] for r in store.column_family_stats().collect()} == {"default": 0, "u": 3}
    store.drop_column_family("u")
    with pytest.raises(ColumnFamilyNotFound):
        store.get_cf("x1", "u")
    assert again(store).list_column_families() == ["default"] and store.get("u#x1") is None


def test_ttl(spark, tmp_path):
    now = [1000.0]
    store = KvStore.open(spark, str(tmp_path / "s"), clock=lambda: now[0])
    store.put_with_ttl("t", "x", 60)
    store.put("p", "y")
    assert store.get_ttl("t") == 60 and store.get_ttl("p") is None
    now[0] += 59
    assert store.get("t") == "x"
    now[0] += 1
    assert store.get("t") is None and not store.exists("t") and store.count() == 1


def test_snapshot_clear_vacuum(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(retained_versions=1))
    store.batch_put([("a", 1)])
    before = store.snapshot()
    store.put("a", 2)
    store.put("b", 3)
    store.flush()
    assert before.get("a") == 1 and not before.exists("b") and rows_of(before.scan_prefix()) == [("a", 1)]
    store.clear()
    assert store.count() == 0 and before.get("a") == 1
    assert store.vacuum() > 0
    assert again(store).count() == 0


def test_leveled_compaction_keeps_files_few(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(auto_compact=True, levels=LevelPolicy(max_l0_files=3)))
    for i in range(9):
        store.put(f"k{i}", i)
        store.flush()
    runs = store.manifests.read().runs
    assert sum(r.level == 0 for r in runs) <= 4 and any(r.level == 1 for r in runs)
    assert [store.get(f"k{i}") for i in (0, 8)] == [0, 8]
    assert store.health_check() == "Healthy" and store.metrics_summary().startswith("Keys: 9, ") and "tidemark_runs" in store.export_metrics_prometheus()
    store.files.remove(runs[0].path)
    assert store.health_check() == "Unhealthy"


def test_append_frame_and_values(spark, store):
    from tidemark.functions.values import INT64, value

    df = spark.range(1000).selectExpr("format_string('k%04d', id % 500) AS k", "id AS ordinal")
    store.append(df.withColumn("v", value(INT64, df["ordinal"])))
    store.flush()
    assert store.count() == 500 and store.get("k0001") == 501
    values = {"s": "é", "i": -(2**63), "u": 2**64 - 1, "f": 1.5, "b": False, "y": b"\x00\xff", "j": {"a": [1, None]}, "e": ""}
    store.batch_put(values.items())
    store.compact()
    assert {k: store.get(k) for k in values} == values


def test_commit_conflicts_are_rebased(store):
    other = again(store)
    store.batch_put([("a", 1)])
    other.batch_put([("b", 2)])
    assert store.count() == 2
    with pytest.raises(CommitConflict):
        store.files.create("manifest/v000000000001.json", "{}")


def test_random_operations_match_a_dictionary(store):
    rng, model = random.Random(5), {}
    for step in range(60):
        keys = [f"{rng.choice('ab')}:{rng.randrange(12):02}" for _ in range(rng.randrange(1, 6))]
        what = rng.random()
        if what < 0.55:
            items = [(k, rng.randrange(1000)) for k in keys]
            store.batch_put(items)
            model.update(items)
        elif what < 0.8:
            store.batch_delete(keys)
            for k in keys:
                model.pop(k, None)
        elif what < 0.9:
            store.flush()
        else:
            store.compact(levels=rng.choice([None, [0]]), to_level=rng.choice([None, 1]))
        if step % 12 == 11:
            assert rows_of(store.scan_all()) == sorted(model.items())
            assert rows_of(store.scan_range_with_values("a:03", "b:0")) == sorted((k, v) for k, v in model.items() if "a:03" <= k < "b:1")
            assert store.batch_get(keys) == [model.get(k) for k in keys]
    assert rows_of(again(store).scan_all()) == sorted(model.items())


# ------------------------------------------------------------------------------------------------- several writers at a time


def during_write_runs(store, monkeypatch, act):
    """Lets ``act`` happen once, between the writing of runs and their commit."""
    real, done = store._write_runs, []

    def write(*args):
        made = real(*args)
        if not done:
            done.append(1)
            act()
        return made

    monkeypatch.setattr(store, "_write_runs", write)


def test_one_of_two_writers_creates_a_file(store):
    won, lost = [], []
    start = threading.Barrier(8)

    def write(who):
        start.wait()
        for i in range(20):
            try:
                store.files.create(f"manifest/x{i}.json", str(who))
                won.append((i, who))
            except CommitConflict:
                lost.append(i)

    threads = [threading.Thread(target=write, args=(who,)) for who in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(i for i, _ in won) == list(range(20)) and len(lost) == 140
    assert all(store.files.read(f"manifest/x{i}.json") == str(who) for i, who in won)
    assert not [n for n in store.files.list("manifest") if n.endswith(".tmp")]


def test_no_commit_is_lost_between_handles(store):
    handles = [again(store) for _ in range(4)]

    def write(n):
        for i in range(5):
            handles[n].batch_put([(f"{n}:{i}", i)])

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert store.count() == 20 and store.manifests.read().next_seq == 20


def test_batch_is_atomic(store):
    with pytest.raises(ValueError):
        store.batch_put([("a", 1), ("b", 2), ("c", object())])
    store.put("z", 26)
    store.sync()
    assert rows_of(store.scan_all()) == [("z", 26)]


def test_clear_during_a_flush(store, monkeypatch):
    store.batch_put([("x", 1)])
    during_write_runs(store, monkeypatch, lambda: again(store).clear())
    store.flush()
    assert store.get("x") is None and store.approx_count() == 0


def test_two_flushes_at_a_time(store, monkeypatch):
    store.batch_put([("x", 1)])
    other = again(store)
    during_write_runs(store, monkeypatch, other.flush)
    store.flush()
    assert store.approx_count() == 1 and store.get("x") == 1 and len(store.files.list("runs")) == 1


def test_vacuum_during_a_flush(store, monkeypatch):
    store.batch_put([("x", 1)])
    during_write_runs(store, monkeypatch, lambda: again(store).vacuum())
    store.flush()
    assert again(store).get("x") == 1


def test_vacuum_takes_old_orphans(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(orphan_seconds=0))
    store.batch_put([("x", 1)])
    store.flush()
    spark.range(3).write.parquet(store.files.at("runs/dead"))
    time.sleep(0.05)
    assert store.vacuum() == 1 and store.get("x") == 1
    spark.range(3).write.parquet(store.files.at("runs/dead"))
    assert KvStore.open(spark, str(tmp_path / "s")).vacuum() == 0


def test_tombstone_stays_over_an_older_segment(store):
    """The delete is in a run, the older put still in the changelog: merging the run must not bring the key back."""
    store.batch_put([("x", "old")])
    store.batch_delete(["x"])
    old, new = store.manifests.read().segments
    made = store._write_runs(store._segments([new]), 0, 1)
    store.manifests.commit(lambda m: replace(m, runs=tuple(made), segments=(old,)))
    store._merge(store.manifests.read(), store.manifests.read().runs, 1)
    assert store.get("x") is None and store.approx_count() == 1
    store.compact()
    assert store.get("x") is None and store.approx_count() == 0


def test_merge_is_made_again_if_an_older_run_came(store, monkeypatch):
    store.batch_put([("x", "old")])
    store.flush()
    older = store.manifests.read().runs
    store.batch_delete(["x"])
    store.flush()
    newer = tuple(r for r in store.manifests.read().runs if r not in older)
    store.manifests.commit(lambda m: replace(m, runs=newer))
    during_write_runs(store, monkeypatch, lambda: store.manifests.commit(lambda m: replace(m, runs=(*m.runs, *older))))
    done = store._merge(store.manifests.read(), newer, 1)
    assert done["removed"] == 0 and store.get("x") is None
    monkeypatch.undo()
    during_write_runs(store, monkeypatch, lambda: again(store).compact())
    with pytest.raises(StorageError):
        store._merge(store.manifests.read(), store.manifests.read().runs, 1)
    assert store.get("x") is None


def test_stream_batches_are_in_the_commit(spark, store):
    one = spark.createDataFrame([("a", 0)], "k string, ordinal long").withColumn("v", value(INT64, F.col("ordinal")))
    assert store.append(one, stream=("s", 0)) and not store.append(one, stream=("s", 0))
    # nothing in a batch, and a batch that another handle commits first
    assert store.append(one.filter("false"), stream=("s", 1)) and not store.append(one, stream=("s", 1))
    assert store.manifests.read().next_seq == 1 and store.manifests.read().streams == {"s": 1} and len(store.files.list("changelog")) == 1
    assert not store._append(one.withColumnRenamed("ordinal", "seq").selectExpr("k", "seq", "false AS deleted", "v", "CAST(null AS long) AS expires_at"), None, ("s", 1))
    assert store.manifests.read().next_seq == 1 and len(store.files.list("changelog")) == 1


# ------------------------------------------------------------------------------------------------------------- the rest


def test_flush_is_split_by_size(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(levels=LevelPolicy(target_size=20_000)))
    df = spark.range(4000).selectExpr("format_string('k%05d', id * 7 % 4000) AS k", "id AS ordinal")
    store.append(df.withColumn("v", value(INT64, F.col("ordinal"))))
    store.flush()
    runs = sorted(store.manifests.read().runs, key=lambda r: r.smallest_key)
    assert len(runs) > 1 and all(a.largest_key < b.smallest_key for a, b in zip(runs, runs[1:], strict=False))
    assert store.count() == store.approx_count() == 4000 and store.get("k00007") == 1


def test_many_segments_are_one_scan(store):
    for i in range(12):
        store.batch_put([(f"k{i % 5}", i), ("same", i)])
    state = store.state()
    assert state._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows_of(store.scan_all()) == [("k0", 10), ("k1", 11), ("k2", 7), ("k3", 8), ("k4", 9), ("same", 11)]


def test_expired_rows_are_reclaimed(spark, tmp_path):
    now = [1000.0]
    store = KvStore.open(spark, str(tmp_path / "s"), clock=lambda: now[0])
    store.batch_put([("t", "older"), ("p", 1)])
    store.flush()
    store.compact()
    store.put_with_ttl("t", "short", 10)
    store.flush()
    now[0] += 10
    # an older version lies below: what has expired stays as a tombstone
    store.compact(levels=[0], to_level=0)
    assert store.get("t") is None and store.approx_count() == 3
    store.compact()
    assert store.get("t") is None and store.approx_count() == 1 and store.get("p") == 1


def test_bulk_import_and_memtable_metrics(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(flush_rows=4, auto_compact=True, levels=LevelPolicy(max_l0_files=1)))
    store.set_bulk_import(True)
    for i in range(10):
        store.put(f"k{i}", "x" * i)
    m = store.memtable_metrics()
    assert m["active_entries"] == 2 and m["active_size"] > 17 and m["immutable_count"] == 2 and m["immutable_size"] > 0
    assert not store.manifests.read().runs
    for _ in range(3):
        store.flush()
        store.put("z", 1)
    assert {r.level for r in store.manifests.read().runs} == {0}
    store.set_bulk_import(False)
    store.flush()
    assert {r.level for r in store.manifests.read().runs} == {1} and store.count() == 11
    assert store.memtable_metrics() == {"active_entries": 0, "active_size": 0, "immutable_count": 0, "immutable_size": 0}


def test_compaction_history_is_whole(store, monkeypatch):
    monkeypatch.setattr("tidemark.sources.store.LISTED", 2)
    for i in range(6):
        store.put("k", i)
        store.flush()
        store.compact()
    assert len(store.compaction_stats()) == 6 and len(store.manifests.read().compactions) <= 3
    store.reset_compaction_stats()
    assert store.compaction_stats() == []


def test_adaptive_compaction_follows_the_workload(spark, tmp_path):
    store = KvStore.open(spark, str(tmp_path / "s"), Config(adaptive=True, levels=LevelPolicy(max_l0_files=2)))
    for i in range(4):
        store.put(f"k{i}", i)
        store.flush()
    assert store.is_adaptive_compaction_enabled() and store.get_workload_characteristics() is None
    # busy: not now
    store.update_workload_characteristics(10, 90, resource_utilization=0.9)
    assert store.compact_if_needed() is None
    # writes with high amplification: by size, of which four alike are enough
    store.update_workload_characteristics(90, 10, write_amplification=3.0)
    assert store.get_workload_characteristics()["workload"] == "WriteHeavy" and store._policy()[0] == "size_tiered"
    assert store.compact_if_needed()["inputs"] == 4
    store.update_performance_metrics(1.0, 1, 2, 11, cpu=0.1)
    store.update_workload_characteristics(10, 90)
    assert store._policy()[0] == "leveled" and store._policy()[2] == {0, 1, 2, 3} and store.get_performance_metrics()["p99_ms"] == 11.0
    for _ in range(12):
        store.update_workload_characteristics(1, 1)
    assert len(store.workload_history()) == 10 and len(store.performance_history()) == 1
    store.reset_adaptive()
    assert store.workload_history() == [] and store.get_performance_metrics() is None


def test_monitor(store):
    store.batch_put([("a", 1), ("b", 2)])
    store.flush()
    monitor, heard = Monitor(store, interval=0.05), []
    monitor.add_alert_rule(AlertRule("many", "storage_total_keys", "GreaterThan", 1.0, "High"))
    monitor.add_alert_rule(AlertRule("off", "storage_total_keys", "GreaterThan", 0.0, enabled=False))
    monitor.add_notification_channel(lambda alert: heard.append(alert["rule_id"]))
    monitor.add_notification_channel(lambda alert: 1 / 0)
    monitor.update_stats(memory_utilization_percent=85.0, cache_hit_rate=0.4)
    store.clock = lambda: 77
    assert [a["alert_id"] for a in monitor.collect()] == ["many_77"] and monitor.collect() == [] and heard == ["many"]
    assert monitor.get_metrics()["storage_total_keys"] == 2.0 and len(monitor.get_metrics()) == 12
    assert {c["check_name"]: c["status"] for c in monitor.get_health_checks()} == {"memory_usage": "Degraded", "cache_performance": "Unhealthy", "error_rate": "Healthy"}
    store.clock = lambda: 78
    monitor.start()
    for _ in range(200):
        if len(monitor.get_alerts()) > 1:
            break
        time.sleep(0.05)
    monitor.stop()
    assert [a["alert_id"] for a in monitor.get_alerts()] == ["many_77", "many_78"]
    with pytest.raises(ValueError):
        monitor.update_stats(nothing=1.0)
    with pytest.raises(ValueError):
        AlertRule("x", "m", "Near", 1.0)
