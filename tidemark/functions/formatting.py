"""Numbers for people.

Two decimals are rounded from the exact binary value, and exact ties go to the even digit. Neither ``format_string`` nor
``bround`` does that: both start from the shortest decimal that reads back as the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of bytes, by powers of 1024; the limits and texts of the functions below are fixed, too.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _two(x: Column) -> Column:
    """A double with two decimals."""
    x = x.cast("double")
    # product and error together are exactly 100 x (Dekker's product; 100 needs no splitting)
    product = x * 100.0
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 100.0 - product) + (x - high) * 100.0
    near = F.rint(product)
    off = product - near
    cents = near + F.when((off == 0.5) & (error > 0), 1.0).when((off == -0.5) & (error < 0), -1.0).otherwise(0.0)
    whole = F.abs(cents).cast("decimal(38,0)")
    digits = F.concat(F.floor(whole / 100).cast("decimal(38,0)").cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))
    return F.concat(F.when(cents < 0, "-").otherwise(""), digits)


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[1:], 1):
        out = F.when(n >= float(1024**power), F.concat(_two(n.cast("double") / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(milliseconds: Column) -> Column:
    ms = milliseconds.cast("long")
    total = F.floor(ms / 1000)
    hours, minutes, seconds, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60, ms % 1000
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, seconds))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds))
        .when(seconds > 0, F.format_string("%d.%03ds", seconds, rest))
        .otherwise(F.format_string("%dms", rest))
    )


def format_percentage(part: Column, total: Column) -> Column:
    share = F.try_divide(part.cast("double"), total.cast("double")) * 100
    return F.when(F.coalesce(share, F.lit(0.0)) == 0, "0.00%").when(share < 0.01, "<0.01%").when(share >= 100, "100.00%").otherwise(F.concat(_two(share), F.lit("%")))


def format_rate(count: Column, seconds: Column) -> Column:
    rate = F.try_divide(count.cast("double"), seconds.cast("double"))
    return (
        F.when(seconds == 0, "∞")
        .when(rate >= 1e6, F.concat(_two(rate / 1e6), F.lit("M ops/s")))
        .when(rate >= 1e3, F.concat(_two(rate / 1e3), F.lit("K ops/s")))
        .otherwise(F.concat(_two(rate), F.lit(" ops/s")))
    )


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def bloom_bits(n: Column, p: Column) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p."""
    return F.ceil(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0)))


def bloom_hashes(bits: Column, n: Column) -> Column:
    return F.ceil(bits / n * F.ln(F.lit(2.0)))


def ops_per_second(operations: Column, milliseconds: Column) -> Column:
    """Operations in a second, 0 where no time has passed."""
    return F.coalesce(F.try_divide(operations.cast("double") * 1000, milliseconds.cast("double")), F.lit(0.0))


def timestamp_secs() -> Column:
    """Now, in whole seconds since the epoch."""
    return F.unix_timestamp()
