"""Times, buckets and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticks_to_ms(ticks: Column) -> Column:
    """90 kHz ticks to milliseconds; both engines divide integers here (ticks are not negative)."""
    return F.floor(ticks / 90).cast("long")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours go on beyond 24."""
    q = lambda a, n: F.floor(a / n).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", q(ms, 3600000), F.pmod(q(ms, 60000), F.lit(60)), F.pmod(q(ms, 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def height_bucket(h: Column) -> Column:
    return F.when(h < 90, 80).when(h < 140, 96).otherwise(160)


def luma(r: Column, g: Column, b: Column) -> Column:
    return (F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def margin(height: Column, fraction: float = 0.10, least: int = 6) -> Column:
    return F.greatest(F.lit(least), F.rint(height * fraction).cast("int"))
