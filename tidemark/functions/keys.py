"""Keys: byte order, prefixes, ranges and column families.

Keys are STRING under the default binary collation, whose order is the order of UTF-8 bytes. All predicates are plain
comparisons on the key column, so they are pushed down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CF_SEPARATOR = "#"
DEFAULT_CF = "default"


def succ(end: str) -> str:
    """The exclusive bound of a range that includes ``end`` and every key that has ``end`` as a prefix; "" stays open.

    The last character goes up by one; where that would leave Unicode or hit a surrogate, U+0001 is appended instead.
    """
    if not end:
        return ""
    code = ord(end[-1]) + 1
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return end + "\x01"
    return end[:-1] + chr(code)


def succ_column(end: Column) -> Column:
    """``succ`` of a column whose values end in an ASCII character."""
    bumped = F.concat(F.substring(end, F.lit(1), F.length(end) - 1), F.chr(F.ascii(F.substring(end, F.length(end), F.lit(1))) + 1))
    return F.when(end == "", end).otherwise(bumped)


def prefix_pred(key: Column, prefix: str) -> Column:
    return F.startswith(key, F.lit(prefix)) if prefix else F.lit(True)


def range_pred(key: Column, start: str, end: str, end_mode: str = "succ") -> Column:
    """``[start, succ(end))``, or ``[start, end]`` with ``end_mode="inclusive"``. An empty end is open."""
    pred = key >= start
    if not end:
        return pred
    if end_mode == "inclusive":
        return pred & (key <= end)
    if end_mode != "succ":
        raise ValueError(f"end_mode must be succ or inclusive, not {end_mode!r}")
    return pred & (key < succ(end))


def cf_key(cf: str, key: str) -> str:
    return f"{cf}{CF_SEPARATOR}{key}"


def cf_key_column(cf: Column, key: Column) -> Column:
    return F.concat(cf, F.lit(CF_SEPARATOR), key)


def strip_prefix(key: Column, prefix: str) -> Column:
    return F.substring(key, F.lit(len(prefix) + 1), F.length(key))


def matches_pattern(key: Column, pattern: str) -> Column:
    """``*x*`` contains, ``*x`` ends with, ``x*`` begins with, else equal; nothing else is special."""
    if len(pattern) > 1 and pattern.startswith("*") and pattern.endswith("*"):
        return F.contains(key, F.lit(pattern[1:-1]))
    if pattern.startswith("*"):
        return F.endswith(key, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(key, F.lit(pattern[:-1]))
    return key == pattern


def run_filename(level: int, seq: int) -> str:
    return f"L{level}_{seq:016x}"


#: Names of run and write-ahead-log files elsewhere, by level and sequence (decimal).
SSTABLE_NAME, WAL_NAME = "L%02d_%016d.sst", "wal_%016d.log"


def sstable_filename(level: Column, seq: Column) -> Column:
    return F.format_string(SSTABLE_NAME, level, seq)


def wal_filename(seq: Column) -> Column:
    return F.format_string(WAL_NAME, seq)


def parse_run_filename(name: Column) -> tuple[Column, Column]:
    """(level, sequence) of ``L{level}_{hex}.sst`` and ``sstable_l{level}_t{time}[_{hex}].sst``; nulls for other names."""
    new, old = r"^L(\d+)_([0-9a-f]+)\.sst$", r"^sstable_l(\d+)_t(\d+)(?:_([0-9a-f]+))?\.sst$"
    level = F.when(name.rlike(new), F.regexp_extract(name, new, 1)).when(name.rlike(old), F.regexp_extract(name, old, 1))
    digits = F.when(name.rlike(new), F.regexp_extract(name, new, 2)).when(name.rlike(old), F.nullif(F.regexp_extract(name, old, 3), F.lit("")))
    return level.cast("int"), F.conv(digits, 16, 10).cast("long")
