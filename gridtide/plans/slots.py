"""Regular time steps as integers.

A *slot* counts steps since 1970-01-01, so ordinals, chunks and lags on a regular
grid are integer arithmetic and need neither a sort nor a join. Everything works on
TIMESTAMP_NTZ through date parts, independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency aliases of the reference data model.
ALIASES = {"T": "minute", "H": "hour", "D": "day", "M": "month"}
SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def unit_of(freq: str) -> str:
    unit = ALIASES.get(freq, freq)
    if unit not in SECONDS and unit != "month":
        raise ValueError(f"unknown frequency {freq!r}")
    return unit


def epoch_seconds(ts: str) -> Column:
    return F.expr(f"unix_date(to_date(`{ts}`)) * 86400L + hour(`{ts}`) * 3600 + minute(`{ts}`) * 60 + second(`{ts}`)")


def slot_of(ts: str, freq: str) -> Column:
    """Slot of a timestamp column."""
    day = f"unix_date(to_date(`{ts}`))"
    return F.expr({
        "day": f"CAST({day} AS BIGINT)",
        "hour": f"{day} * 24L + hour(`{ts}`)",
        "minute": f"{day} * 1440L + hour(`{ts}`) * 60 + minute(`{ts}`)",
        "month": f"(year(`{ts}`) - 1970) * 12L + month(`{ts}`) - 1",
    }[unit_of(freq)])


def slot_time(slot: str, freq: str) -> Column:
    """Label of a slot column: its start, or the last day for a month."""
    n, origin = f"CAST(`{slot}` AS INT)", "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return F.expr({
        "day": f"{origin} + make_dt_interval({n})",
        "hour": f"{origin} + make_dt_interval(0, {n})",
        "minute": f"{origin} + make_dt_interval(0, 0, {n})",
        "month": f"CAST(last_day(add_months(DATE'1970-01-01', {n})) AS TIMESTAMP_NTZ)",
    }[unit_of(freq)])
