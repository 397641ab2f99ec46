"""Checks of keys and values as columns that name the first broken rule (null: none), and integrity checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.functions.keys import matches_pattern
from tidemark.functions.values import JSON, NULL, STRING, byte_sum, serialized_size


@dataclass(frozen=True)
class KeyRules:
    min_length: int = 1
    max_length: int = 1024
    allow_empty: bool = False
    allow_control_chars: bool = False
    ascii_only: bool = False
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValueRules:
    max_size: int = 1 << 20
    allow_null: bool = True
    allow_empty_strings: bool = True
    max_string_length: int = 1 << 20
    max_json_depth: int = 32


@dataclass(frozen=True)
class Rules:
    enabled: bool = True
    key: KeyRules = field(default_factory=KeyRules)
    value: ValueRules = field(default_factory=ValueRules)


def _first(cases: list[tuple[Column, Column | str]]) -> Column:
    out = F.lit(None).cast("string")
    for broken, reason in reversed(cases):
        out = F.when(broken, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def key_error(key: Column, rules: KeyRules = KeyRules()) -> Column:
    """Lengths are in bytes."""
    size = F.octet_length(key)
    cases: list[tuple[Column, Column | str]] = [] if rules.allow_empty else [(size == 0, "key cannot be empty")]
    cases += [
        (size < rules.min_length, F.format_string(f"key length %d is less than minimum {rules.min_length}", size)),
        (size > rules.max_length, F.format_string(f"key length %d exceeds maximum {rules.max_length}", size)),
    ]
    if rules.ascii_only:
        cases.append((size != F.length(key), "key must be ASCII"))
    if not rules.allow_control_chars:
        cases.append((key.rlike(r"\p{Cc}"), "key contains control characters"))
    cases += [(~matches_pattern(key, p), f"key does not match required pattern: {p}") for p in rules.patterns]
    return _first(cases)


def depth_of(x: object) -> int:
    """Containers one in another: a scalar or an empty container is 1."""
    deepest, stack = 0, [(x, 1)]
    while stack:
        y, d = stack.pop()
        deepest = max(deepest, d)
        inner = y.values() if isinstance(y, dict) else y if isinstance(y, list) else ()
        stack.extend((z, d + 1) for z in inner)
    return deepest


@F.pandas_udf(IntegerType())
def json_depth(text: pd.Series) -> pd.Series:
    """Depth of JSON documents; null where the text is null or no JSON."""

    def one(x: str | None) -> int | None:
        try:
            return None if x is None else depth_of(json.loads(x))
        except ValueError:
            return None

    return text.map(one, na_action="ignore").astype("Int32")


def value_error(v: Column, rules: ValueRules = ValueRules(), depth: Column | None = None) -> Column:
    """``depth`` is the JSON depth where it is at hand; otherwise it is computed, in Python, for Json values."""
    size = serialized_size(v)
    text = F.octet_length(v["s"])
    if depth is None:
        depth = json_depth(F.when(v["tag"] == JSON, v["j"]))
    cases: list[tuple[Column, Column | str]] = [] if rules.allow_null else [(v["tag"] == NULL, "null values are not allowed")]
    cases.append((size > rules.max_size, F.format_string(f"value size %d exceeds maximum {rules.max_size}", size)))
    if not rules.allow_empty_strings:
        cases.append(((v["tag"] == STRING) & (text == 0), "empty strings are not allowed"))
    cases += [
        ((v["tag"] == STRING) & (text > rules.max_string_length), F.format_string(f"string length %d exceeds maximum {rules.max_string_length}", text)),
        ((v["tag"] == JSON) & (depth > rules.max_json_depth), F.format_string(f"JSON depth %d exceeds maximum {rules.max_json_depth}", depth)),
    ]
    return _first(cases)


def split_valid(df: DataFrame, rules: Rules = Rules(), key: str = "k", value: str | None = "v") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``): the key is judged first, then the value."""
    if not rules.enabled:
        return df, df.withColumn("reason", F.lit(None).cast("string")).filter(F.lit(False))
    reason = key_error(F.col(key), rules.key)
    if value is not None:
        reason = F.coalesce(reason, value_error(F.col(value), rules.value))
    judged = df.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def integrity_error(data: Column, checksum: Column | None = None, size: Column | None = None) -> Column:
    """The first broken of: not empty, the expected size, the expected byte sum."""
    cases: list[tuple[Column, Column | str]] = [(F.octet_length(data) == 0, "Data cannot be empty")]
    if size is not None:
        cases.append((F.octet_length(data) != size, F.format_string("Size mismatch: expected %d, got %d", size, F.octet_length(data))))
    if checksum is not None:
        cases.append((byte_sum(data) != checksum, F.format_string("Checksum mismatch: expected %d, got %d", checksum, byte_sum(data))))
    return _first(cases)
