"""Values: a tagged union of eight variants as one struct, with a nullable field for each.

Fixed values: the variants in the order of their tags.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ("String", "Int64", "UInt64", "Float64", "Bool", "Bytes", "Json", "Null")
STRING, INT64, UINT64, FLOAT64, BOOL, BYTES, JSON, NULL = range(8)
VALUE = "struct<tag:tinyint,s:string,i:bigint,u:decimal(20,0),d:double,b:boolean,bin:binary,j:string>"
VALUE_TYPE = T.StructType([
    T.StructField("tag", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("i", T.LongType()), T.StructField("u", T.DecimalType(20, 0)),
    T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("bin", T.BinaryType()), T.StructField("j", T.StringType()),
])
_FIELD = {STRING: ("s", "string"), INT64: ("i", "bigint"), UINT64: ("u", "decimal(20,0)"), FLOAT64: ("d", "double"), BOOL: ("b", "boolean"), BYTES: ("bin", "binary"), JSON: ("j", "string")}
#: Bytes that a string, a byte vector and a JSON node take besides their content, on a 64-bit machine.
_HEADER, _JSON_NODE = 24, 32


class ValueError_(ValueError):
    """A value that can't be encoded or decoded."""


def value(tag: int, content: Column | None = None) -> Column:
    """A VALUE of one variant."""
    fields = [F.lit(tag).cast("tinyint").alias("tag")]
    for t, (name, kind) in _FIELD.items():
        fields.append((content if t == tag and content is not None else F.lit(None)).cast(kind).alias(name))
    return F.struct(*fields)


def encode(x: Any) -> tuple:
    """The row of a Python value: bool, int (UInt64 beyond the range of Int64), float, str, bytes, None, or JSON containers."""
    row: list[Any] = [NULL] + [None] * 7
    if x is None:
        return tuple(row)
    if isinstance(x, bool):
        tag = BOOL
    elif isinstance(x, int):
        if not -(1 << 63) <= x < 1 << 64:
            raise ValueError_(f"{x} fits neither Int64 nor UInt64")
        tag = INT64 if x < 1 << 63 else UINT64
    elif isinstance(x, float):
        tag = FLOAT64
    elif isinstance(x, str):
        tag = STRING
    elif isinstance(x, (bytes, bytearray)):
        tag, x = BYTES, bytes(x)
    elif isinstance(x, (dict, list, tuple)):
        tag, x = JSON, json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    else:
        raise ValueError_(f"no variant for {type(x).__name__}")
    from decimal import Decimal

    row[0], row[1 + tag] = tag, Decimal(x) if tag == UINT64 else x
    return tuple(row)


def decode(row: Any) -> Any:
    """The Python value of a VALUE row."""
    if row is None or row[0] is None or row[0] == NULL:
        return None
    x = row[1 + row[0]]
    return {UINT64: int, BYTES: bytes, JSON: json.loads}.get(row[0], lambda y: y)(x)


def is_null(v: Column) -> Column:
    return v.isNull() | (v["tag"] == NULL)


def type_name(v: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAGS)), v["tag"].cast("int") + 1)


def _by_tag(v: Column, cases: dict[int, Column]) -> Column:
    out = None
    for tag, x in cases.items():
        out = F.when(v["tag"] == tag, x) if out is None else out.when(v["tag"] == tag, x)
    return out


def serialized_size(v: Column) -> Column:
    """Bytes of the content; JSON by its compact text."""
    eight = F.lit(8).cast("long")
    return _by_tag(v, {STRING: F.octet_length(v["s"]).cast("long"), INT64: eight, UINT64: eight, FLOAT64: eight, BOOL: F.lit(1).cast("long"), BYTES: F.octet_length(v["bin"]).cast("long"), JSON: F.octet_length(v["j"]).cast("long"), NULL: F.lit(0).cast("long")})


def memory_size(v: Column) -> Column:
    """Content plus headers; JSON is estimated by its text, as its nodes are not at hand."""
    extra = _by_tag(v, {STRING: F.lit(_HEADER), BYTES: F.lit(_HEADER), JSON: F.lit(_JSON_NODE)})
    return serialized_size(v) + F.coalesce(extra, F.lit(0)).cast("long")


def _little_endian(n: Column) -> Column:
    """The eight bytes of a BIGINT, least significant first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1))))


def _double_bits(d: Column) -> Column:
    """The IEEE bits of a double, by arithmetic: there is no function that gives them."""
    a = F.abs(d)
    exponent = F.floor(F.log2(a))
    exponent = exponent - F.when(F.pow(F.lit(2.0), exponent) > a, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), exponent + 1) <= a, 1).otherwise(0)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0))).cast("long")
    bits = F.when(F.isnan(d), F.lit(0x7FF8 << 48)).when(a == float("inf"), F.lit(0x7FF0 << 48)).when(a == 0, F.lit(0)).when(a < 2.0**-1022, tiny).otherwise(normal.cast("long"))
    return F.when((d < 0) | (d.cast("string") == "-0.0"), bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)


def to_bytes(v: Column) -> Column:
    """Content as bytes: text in UTF-8, numbers little-endian, a bool as one byte, null empty."""
    unsigned = F.when(v["u"] > F.lit(str((1 << 63) - 1)).cast("decimal(20,0)"), (v["u"] - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("long")).otherwise(v["u"].cast("long"))
    return _by_tag(v, {
        STRING: F.encode(v["s"], "UTF-8"), INT64: _little_endian(v["i"]), UINT64: _little_endian(unsigned), FLOAT64: _little_endian(_double_bits(v["d"])),
        BOOL: F.when(v["b"], F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), BYTES: v["bin"], JSON: F.encode(v["j"], "UTF-8"), NULL: F.unhex(F.lit("")),
    })


def display(v: Column) -> Column:
    """For people: text as it is, bytes in lower-case hex, null as "null"; a double as Spark prints it."""
    return _by_tag(v, {STRING: v["s"], INT64: v["i"].cast("string"), UINT64: v["u"].cast("string"), FLOAT64: v["d"].cast("string"), BOOL: v["b"].cast("string"), BYTES: F.lower(F.hex(v["bin"])), JSON: v["j"], NULL: F.lit("null")})


def to_json(x: Any) -> str:
    """Externally tagged JSON of a Python value: ``{"Int64":42}``, bytes as numbers, ``"Null"``."""
    row = encode(x)
    name, content = TAGS[row[0]], decode(row)
    if row[0] == NULL:
        return '"Null"'
    if row[0] == BYTES:
        content = list(content)
    if row[0] == FLOAT64 and not math.isfinite(content):
        content = None
    return json.dumps({name: content}, separators=(",", ":"), ensure_ascii=False)


def from_json(text: str) -> Any:
    """The value of tagged JSON; any JSON without a tag is a Json value. A tag with the wrong content is an error."""
    try:
        x = json.loads(text)
    except ValueError as e:
        raise ValueError_(str(e)) from e
    if x == "Null":
        return None
    if not (isinstance(x, dict) and len(x) == 1 and next(iter(x)) in TAGS):
        return Json(x)
    (name, content), whole = next(iter(x.items())), lambda y: isinstance(y, int) and not isinstance(y, bool)
    good = {
        "String": isinstance(content, str), "Int64": whole(content) and -(1 << 63) <= content < 1 << 63, "UInt64": whole(content) and 0 <= content < 1 << 64,
        "Float64": isinstance(content, (int, float)) and not isinstance(content, bool), "Bool": isinstance(content, bool),
        "Bytes": isinstance(content, list) and all(whole(b) and 0 <= b < 256 for b in content), "Json": True, "Null": content is None,
    }[name]
    if not good:
        raise ValueError_(f"{name} can't hold {content!r}")
    return {"Float64": float, "Bytes": bytes, "Json": Json}.get(name, lambda y: y)(content)


class Json:
    """A JSON value told apart from a plain scalar."""

    def __init__(self, content: Any) -> None:
        self.content = content

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Json) and self.content == other.content

    __hash__ = None

    def __repr__(self) -> str:
        return f"Json({self.content!r})"


def json_tag(text: Column) -> Column:
    """The variant that a JSON document decodes to, by its single top-level key; untagged documents are Json."""
    keys = F.json_object_keys(text)
    known = F.array(*map(F.lit, TAGS))
    return F.when(F.trim(text) == '"Null"', F.lit("Null")).when((F.size(keys) == 1) & F.array_contains(known, F.get(keys, F.lit(0))), F.get(keys, F.lit(0))).otherwise("Json")


def byte_sum(data: Column) -> Column:
    """Sum of the bytes modulo 2**32."""
    digits = F.hex(data)
    each = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(digits) > 0, F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b) % (1 << 32)).otherwise(0).cast("long")
