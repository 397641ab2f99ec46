import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CLASSES, KvError, StorageError, InvalidKey, KeyNotFound, error_dimension, handle, retry, user_message, with_context
from tidemark.functions import formatting, keys, validation, values
from tidemark.functions.values import Json, ValueError_, decode, encode, from_json, to_json


def column(spark, x, *rows, schema):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(x).collect()]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1), st.text())
def test_succ_bounds_everything_under_the_end(end, rest):
    assume = end[-1] < "퟿" or "" <= end[-1] < "\U0010ffff"
    key = end + rest
    if assume:
        assert end.encode("utf-8", "surrogatepass") <= key.encode("utf-8", "surrogatepass") < keys.succ(end).encode("utf-8", "surrogatepass")
    else:
        assert keys.succ(end) == end + "\x01"


def test_succ_edges():
    assert [keys.succ(x) for x in ("", "a", "az", "퟿", "\U0010ffff")] == ["", "b", "a{", "퟿\x01", "\U0010ffff\x01"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**64 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text(), st.binary(), st.lists(st.integers()), st.dictionaries(st.text(), st.integers(), min_size=2)))
def test_values_survive_both_encodings(x):
    assert decode(encode(x)) == x
    back = from_json(to_json(x))
    assert (back.content if isinstance(back, Json) else back) == x


def test_tagged_json_rules():
    assert from_json('{"Int64":5}') == 5 and from_json('"Null"') is None and from_json("7") == Json(7)
    assert from_json('{"a":1,"b":2}') == Json({"a": 1, "b": 2}) and to_json(b"\x01\x02") == '{"Bytes":[1,2]}'
    assert to_json(math.nan) == '{"Float64":null}'
    for bad in ('{"String":5}', '{"Bytes":[256]}', '{"Int64":1.5}', '{"Float64":null}', "{"):
        with pytest.raises(ValueError_):
            from_json(bad)
    with pytest.raises(ValueError_):
        encode(2**64)


def test_sizes_bytes_and_display(spark):
    cases = [None, True, False, -1, 2**63 - 1, -(2**63), 2**64 - 1, 0.0, -0.0, 1.5, -2.75e-300, 5e-324, 1.7976931348623157e308, 0.1, math.inf, -math.inf, "é", "", b"\x00\xff", {"a": 1}]
    df = spark.createDataFrame([(i, encode(x)) for i, x in enumerate(cases)], f"n int, v {values.VALUE}")
    got = {r["n"]: r for r in df.select("n", values.serialized_size(F.col("v")).alias("size"), values.memory_size(F.col("v")).alias("mem"), values.to_bytes(F.col("v")).alias("raw"), values.display(F.col("v")).alias("shown"), values.type_name(F.col("v")).alias("kind"), values.is_null(F.col("v")).alias("none")).collect()}
    for i, x in enumerate(cases):
        if x is None:
            raw, kind = b"", "Null"
        elif isinstance(x, bool):
            raw, kind = bytes([x]), "Bool"
        elif isinstance(x, int):
            raw, kind = (struct.pack("<q", x), "Int64") if x < 2**63 else (struct.pack("<Q", x), "UInt64")
        elif isinstance(x, float):
            raw, kind = struct.pack("<d", x), "Float64"
        elif isinstance(x, str):
            raw, kind = x.encode(), "String"
        elif isinstance(x, bytes):
            raw, kind = x, "Bytes"
        else:
            raw, kind = json.dumps(x, separators=(",", ":")).encode(), "Json"
        assert bytes(got[i]["raw"]) == raw, x
        assert got[i]["size"] == len(raw) and got[i]["kind"] == kind and got[i]["none"] == (x is None) and got[i]["mem"] >= len(raw)
    assert got[18]["shown"] == "00ff" and got[0]["shown"] == "null" and got[1]["shown"] == "true"


def test_formatting(spark):
    assert column(spark, formatting.format_bytes(F.col("x")), 0, 512, 1536, 1 << 20, schema="x long") == ["0 B", "512 B", "1.50 KB", "1.00 MB"]
    assert column(spark, formatting.format_duration(F.col("x")), 65_000, 5, 1_005, 3_661_000, schema="x long") == ["1m 5s", "5ms", "1.005s", "1h 1m 1s"]
    assert column(spark, formatting.format_percentage(F.col("x"), F.lit(100.0)), 0.005, 0.0, 50.0, 200.0, schema="x double") == ["<0.01%", "0.00%", "50.00%", "100.00%"]
    assert column(spark, formatting.format_rate(F.col("x"), F.lit(1.0)), 1500, 2_500_000, 3, schema="x long") == ["1.50K ops/s", "2.50M ops/s", "3.00 ops/s"]
    assert column(spark, formatting.format_rate(F.col("x"), F.lit(0.0)), 1, schema="x long") == ["∞"]
    assert column(spark, formatting.with_commas(F.col("x")), 0, 999, 1000, 1234567, schema="x long") == ["0", "999", "1,000", "1,234,567"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=40, max_size=40))
def test_two_decimals_are_exact(spark, xs):
    xs = [*xs, 0.125, 0.375, 2.145, 6.435, 1.005, -0.125, 0.005]
    got = column(spark, formatting._two(F.col("x")), *xs, schema="x double")
    assert [g.replace("-0.00", "0.00") for g in got] == [f"{x:.2f}".replace("-0.00", "0.00") for x in xs]


def test_patterns_and_filenames(spark):
    x = F.col("x")
    assert column(spark, keys.matches_pattern(x, "*b*") & keys.matches_pattern(x, "a*") & keys.matches_pattern(x, "*c"), "abc", "xbc", "a%c", schema="x string") == [True, False, False]
    names = ("L0_0000000000006ddd.sst", "L03_00.sst", "sstable_l2_t100.sst", "sstable_l2_t100_ff.sst", "MANIFEST")
    level, seq = keys.parse_run_filename(x)
    assert column(spark, level, *names, schema="x string") == [0, 3, 2, 2, None]
    assert column(spark, seq, *names, schema="x string") == [0x6DDD, 0, None, 255, None]


def test_validation(spark):
    x = F.col("x")
    assert column(spark, validation.key_error(x), "k", "", "a\x00", "x" * 1025, "é" * 513, schema="x string") == [None, "key cannot be empty", "key contains control characters", "key length 1025 exceeds maximum 1024", "key length 1026 exceeds maximum 1024"]
    assert column(spark, validation.key_error(x, validation.KeyRules(ascii_only=True)), "é", schema="x string") == ["key must be ASCII"]
    assert column(spark, validation.json_depth(x), "1", "{}", "[]", '{"a":[1,{"b":2}]}', None, "{", schema="x string") == [1, 1, 1, 4, None, None]
    rows = [("a", encode({"a": {"b": {"c": {"d": 1}}}})), ("b", encode("x")), ("", encode(1)), ("n", encode(None))]
    df = spark.createDataFrame(rows, f"k string, v {values.VALUE}")
    rules = validation.Rules(value=validation.ValueRules(allow_null=False, max_json_depth=3))
    good, bad = validation.split_valid(df, rules)
    assert [r["k"] for r in good.collect()] == ["b"]
    assert {r["k"]: r["reason"] for r in bad.collect()} == {"a": "JSON depth 5 exceeds maximum 3", "": "key cannot be empty", "n": "null values are not allowed"}
    data = F.encode("x", "UTF-8")
    assert column(spark, validation.integrity_error(data, F.lit(294), F.lit(3)), "abc", "abd", "ab", "", schema="x string") == [None, "Checksum mismatch: expected 294, got 295", "Size mismatch: expected 3, got 2", "Data cannot be empty"]


def test_errors(spark):
    assert error_dimension(spark).count() == len(CLASSES) == 11
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise StorageError("busy")
        return "done"

    assert retry(flaky, sleep=slept.append) == "done" and slept == [0.1, 0.2]
    with pytest.raises(InvalidKey):
        retry(lambda: (_ for _ in ()).throw(InvalidKey("k")), sleep=slept.append)
    with pytest.raises(KvError, match="skipped"):
        handle(KeyNotFound("k"), lambda: 1)
    assert handle(StorageError("x"), lambda: 1) == 1
    wrapped = with_context(InvalidKey("bad"), lambda: "put")
    assert isinstance(wrapped, InvalidKey) and str(wrapped) == "put: bad" and type(with_context(KeyNotFound("x"), "get")) is KvError
    assert user_message("Wal", "x") == "Recovery error: x"
