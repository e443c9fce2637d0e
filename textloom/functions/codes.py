"""Gap and varint coding, sizes and report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "-"


def varint_length(n: Column) -> Column:
    """Bytes of a non-negative integer at seven bits a byte."""
    length = F.lit(9)
    for k in range(8, 0, -1):
        length = F.when(n < F.lit(1 << (7 * k)), F.lit(k)).otherwise(length)
    return length


def human_size(size: Column) -> Column:
    """KB without digits, MB with one, GB with two, by powers of 1024."""
    return (
        F.when(size < 1024**2, F.concat(F.format_string("%.0f", size / 1024), F.lit("KB")))
        .when(size < 1024**3, F.concat(F.format_string("%.1f", size / 1024**2), F.lit("MB")))
        .otherwise(F.concat(F.format_string("%.2f", size / 1024**3), F.lit("GB")))
    )


def clock(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def report_size(size: Column) -> Column:
    return F.when(size.isNull(), BLANK).when(size >= 1e9, F.format_string("%.2f GB", size / 1e9)).otherwise(F.format_string("%.1f MB", size / 1e6))


def report_time(seconds: Column) -> Column:
    m, s = F.floor(F.round(seconds) / 60), (F.round(seconds) % 60).cast("bigint")
    return (
        F.when(seconds.isNull(), BLANK)
        .when(seconds < 90, F.format_string("%.1f s", seconds))
        .when(m >= 60, F.format_string("%d h %d min", F.floor(m / 60), m % 60))
        .otherwise(F.format_string("%d min %02d s", m, s))
    )


def report_number(n: Column) -> Column:
    return F.when(n.isNull(), BLANK).otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit(" ")))


def report_ratio(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (b == 0), BLANK).otherwise(F.format_string("%.2f×", F.try_divide(a, b)))


def report_change(new: Column, base: Column) -> Column:
    """The change in whole per cent with its sign; within half a per cent it is about none."""
    c = F.try_divide(new - base, base)
    return F.when(new.isNull() | base.isNull() | (base == 0), BLANK).when(F.abs(c) < 0.005, "≈ 0 %").otherwise(F.format_string("%+.0f %%", c * 100))
