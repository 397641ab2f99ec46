import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import adaptive, compaction, reads, resolve, stats

RUN = "run_id int, level int, entry_count long, file_size long, smallest_key string, largest_key string, created_at long"


def runs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RUN)


def test_dedupe_by_seq(spark):
    rows = [("key1", 1000, False, "value1"), ("key1", 1001, False, "updated"), ("key2", 1002, False, "value2"), ("key3", 1003, True, None), ("key3", 1000, False, "old")]
    df = spark.createDataFrame(rows, "k string, seq long, deleted boolean, v string")
    live = {("key1", "updated"), ("key2", "value2")}
    assert {(r["k"], r["v"]) for r in resolve.dedupe_runs(df, drop_tombstones=True).collect()} == live
    assert {(r["k"], r["v"]) for r in resolve.latest_wins_ranked(df).collect()} == live
    assert resolve.dedupe_runs(df, drop_tombstones=False).count() == 3
    with_map = df.withColumn("m", F.create_map(F.lit("a"), "v"))
    assert {(r["k"], r["m"]["a"]) for r in resolve.latest_wins(with_map).collect()} == live
    assert resolve.latest_wins(df, as_of=1000).count() == 2 and resolve.latest_wins(df.filter("false")).count() == 0


def test_durable_watermark(spark):
    df = spark.createDataFrame([(1, 100, "a"), (2, 200, "b"), (3, 300, "c")], "generation long, position long, data string")
    slots = df.withColumn("checksum", F.crc32(F.encode("data", "UTF-8")) + F.when(F.col("generation") == 3, 1).otherwise(0)).withColumn("data", F.encode("data", "UTF-8"))
    assert [tuple(r) for r in resolve.durable_watermark(slots).collect()] == [(2, 200)]
    assert resolve.durable_watermark(slots.filter("generation = 3")).count() == 0


def test_leveled_and_tiered_triggers(spark):
    few, many = ([(0, 1, 10, "a", "b", 0)] * n for n in (2, 11))
    assert compaction.should_compact(runs(spark, *few), "leveled") == [] and compaction.should_compact(runs(spark, *many), "leveled") == [0]
    same = [(1, 1, 5 << 20, "a", "b", 0)]
    assert compaction.should_compact(runs(spark, *same * 2), "size_tiered") == [] and compaction.should_compact(runs(spark, *same * 4), "size_tiered") == [1]
    assert compaction.should_compact(runs(spark, *same * 4, *many), "hybrid") == [0, 1]
    apart, together = ([(0, 1, 1, "a", "b", t) for t in times] for times in ((0, 4000, 8000), (0, 10, 8000)))
    assert compaction.should_compact(runs(spark, *apart), "time_windowed") == [] and compaction.should_compact(runs(spark, *together), "time_windowed") == [0]
    assert compaction.time_window_select(runs(spark, *together)).count() == 2
    with pytest.raises(ValueError):
        compaction.should_compact(runs(spark), "none")
    assert compaction.size_tier_select(runs(spark, *same * 4, *[(1, 1, 1, "a", "b", 0)] * 4)).filter("file_size = 1").count() == 4


def test_safe_to_drop(spark):
    inputs, below, aside = runs(spark, (0, 1, 1, "c", "f", 0)), runs(spark, (1, 1, 1, "a", "d", 0)), runs(spark, (1, 1, 1, "g", "z", 0))
    assert not compaction.safe_to_drop(inputs, below) and compaction.safe_to_drop(inputs, aside) and compaction.safe_to_drop(runs(spark), below)


def test_greedy_pack(spark):
    df = spark.createDataFrame([([5, 5, 1, 20, 3],), ([],)], "s array<bigint>")
    assert [r[0] for r in df.select(compaction.greedy_pack(F.col("s"), 10)).collect()] == [[0, 0, 1, 2, 3], []]


def test_policy(spark):
    df = spark.createDataFrame([(0, 0), (8, 2), (2, 8), (5, 5), (7, 3)], "w int, r int")
    assert [r[0] for r in df.select(adaptive.workload(F.col("w"), F.col("r"))).collect()] == ["Unknown", "WriteHeavy", "ReadHeavy", "Mixed", "Unknown"]
    one = df.limit(1).select(adaptive.strategy(F.lit("WriteHeavy"), F.lit(2.5), F.lit(0.0)), adaptive.strategy(F.lit("ReadHeavy"), F.lit(0.0), F.lit(11.0)), adaptive.strategy(F.lit("Mixed"), F.lit(0.0), F.lit(0.0), enabled=False), adaptive.should_schedule(F.lit(0.5), F.lit(0.81), F.lit(0.0)), adaptive.multiplier(F.lit("WriteHeavy"), F.lit(3.0), F.lit(0.0)), adaptive.max_runs(F.lit("ReadHeavy"), F.lit(10))).first()
    assert one[:4] == ("size_tiered", "leveled", "leveled", False) and abs(one[4] - 1.16) < 1e-9 and one[5] == 7


def test_alerts_fire_once_and_history_is_bounded(spark):
    metrics = spark.createDataFrame([("m", 1.0, 10), ("n", 5.0, 10)], "metric string, value double, at long")
    rules = spark.createDataFrame([("r", "m", "EqualTo", 1.0, "High", True), ("q", "n", "LessThan", 5.0, "Low", True), ("off", "n", "GreaterThan", 0.0, "Low", False)], "rule_id string, metric string, condition string, threshold double, severity string, enabled boolean")
    fired = stats.alerts(metrics.unionByName(metrics), rules).collect()
    assert [r["alert_id"] for r in fired] == ["r_10"] and fired[0]["message"] == "m equals 1.0 (current: 1.0, threshold: 1.0)"
    many = spark.range(30).selectExpr("'m' AS metric", "CAST(id AS double) AS value", "id AS at")
    assert stats.bounded_history(many, 10).agg(F.min("at")).first()[0] == 20 and stats.latest_metrics(many).first()["value"] == 29.0


def test_health_and_text(spark):
    rows = spark.createDataFrame([(96.0, 0.6, 11), (50.0, 0.9, 0)], "memory_percent double, cache_hit_rate double, error_count int")
    got = [(r["check_name"], r["status"], r["message"]) for r in stats.health_checks(rows).collect()]
    assert got[:3] == [("memory_usage", "Unhealthy", "Memory usage: 96.0%"), ("cache_performance", "Degraded", "Cache hit rate: 60.0%"), ("error_rate", "Degraded", "Error count: 11")]
    text = rows.limit(1).select(stats.summary(F.lit(3), F.lit(1048576), F.lit(0.5), F.lit(12.34), stats.overall_health(F.lit(0.9), F.lit(1.0), F.lit(0), F.lit(1)))).first()[0]
    assert text == "Keys: 3, Size: 1.00 MB, Cache Hit Rate: 50.0%, Memory: 12.3%, Health: unhealthy"
    spine = {r["level"]: r for r in stats.level_spine(runs(spark, (1, 5, 7, "a", "b", 0), (1, 5, 8, "c", "d", 0)), 3).collect()}
    assert spine[1]["files"] == 2 and spine[1]["avg_bytes"] == 7 and spine[2]["files"] == 0 and spine[0]["smallest_key"] is None
    assert stats.recommendations(runs(spark, *[(0, 1, 70 << 20, "a", "b", 0)] * 5), 0, 60.0, 1, 0).count() == 1 + 5 + 1


def test_batch_get_keeps_order_and_duplicates(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    got = reads.batch_get(state, reads.positions(spark, ["b", "x", "b", "a"])).collect()
    assert [(r["pos"], r["v"]) for r in got] == [(0, 2), (1, None), (2, 2), (3, 1)]
    found = reads.key_to_runs(spark.createDataFrame([("k1",), ("k5",), ("z",)], "k string"), spark.createDataFrame([(1, "k0", "k3"), (2, "a", "zz")], "run_id int, smallest_key string, largest_key string"), cells=2)
    assert {tuple(r) for r in found.collect()} == {("k1", 1), ("k1", 2), ("k5", 2), ("z", 2)}


def test_key_to_runs_of_many_runs_and_one_prefix(spark):
    n = 10_000
    runs_ = spark.range(n).selectExpr("CAST(id AS int) AS run_id", "format_string('order:%08d', id * 10) AS smallest_key", "format_string('order:%08d', id * 10 + 9) AS largest_key")
    wide = spark.createDataFrame([(-1, "order:", "order:9"), (-2, "order:00050000", "order:00060000"), (-3, "b", "a")], "run_id int, smallest_key string, largest_key string")
    keys = spark.range(0, 10 * n, 37).selectExpr("format_string('order:%08d', id) AS k", "id")
    found = reads.key_to_runs(keys, runs_.unionByName(wide))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {tuple(r) for r in found.collect()}
    ids = range(0, 10 * n, 37)
    want = {(f"order:{i:08d}", i // 10) for i in ids} | {(f"order:{i:08d}", -1) for i in ids} | {(f"order:{i:08d}", -2) for i in ids if 50_000 <= i <= 60_000}
    assert got == want
    # a cell holds no more runs than a few times its share
    assert reads.key_to_runs(keys, wide.filter("false")).count() == 0


def test_effects_and_counts_in_blocks(spark):
    rng = random.Random(3)
    # one key has half of all versions
    rows = [(rng.choice(["hot", f"k{rng.randrange(9)}"]), i, rng.random() < 0.4) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, seq long, deleted boolean")
    live, want, running = {}, {}, []
    for k, seq, deleted in sorted(rows, key=lambda r: r[1]):
        was = live.get(k)
        want[seq] = "Tombstone" if deleted else "Inserted" if was is None else "UpdatedLive" if was else "Resurrected"
        live[k] = not deleted
        running.append((seq, sum(live.values())))
    for block, fan in ((100_000, 1000), (50, 1000), (7, 3)):
        assert {r["seq"]: r["effect"] for r in resolve.put_effects(df, block).collect()} == want
        assert sorted((r["seq"], r["live"]) for r in resolve.live_count_running(df, block, fan).collect()) == running
    assert resolve.live_count_running(df.filter("false")).count() == 0
