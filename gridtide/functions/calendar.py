"""Calendar expressions on a TIMESTAMP_NTZ column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "dayofweek": F.weekday(ts),  # Monday is 0
        "day": F.day(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "dayofyear": F.dayofyear(ts),
    }


def flags(hour: Column, dayofweek: Column, quarter: Column) -> dict[str, Column]:
    """Flags from calendar parts that are columns already.

    Season is 0 for January to March, up to 3. Peak hours are 7 to 10 and 18 to 22.
    """
    return {
        "is_weekend": (dayofweek >= 5).cast("int"),
        "is_weekday": (dayofweek < 5).cast("int"),
        "season": quarter - 1,
        "is_peak_hour": (hour.between(7, 10) | hour.between(18, 22)).cast("int"),
    }


def cyclical(hour: Column, month: Column, dayofweek: Column) -> dict[str, Column]:
    out = {}
    for name, part, period in (("hour", hour, 24), ("month", month, 12), ("dow", dayofweek, 7)):
        angle = 2 * F.pi() * part / period
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out
