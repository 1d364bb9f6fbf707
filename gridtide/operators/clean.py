"""Cleaning and gap filling.

Fills are positional: the distance between two rows is their difference in ``pos``, a slot
on a regular grid or a row ordinal. Row counts never change, except in the drop operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.quality import series_stats
from gridtide.operators.resample import resample_daily, resample_hourly
from gridtide.plans.chunks import CHUNK, ROW_CHUNK, attach, known_neighbours, with_row_ordinal
from gridtide.schemas import TARGET
from gridtide.session import materialise


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Keep rows whose null share is below ``threshold``; exactly ``threshold`` goes."""
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(nulls / F.lit(float(len(cols))) < threshold)


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (all columns by default).

    One condition per column: the optimizer pushes and infers each on its own, while a single
    condition over many computed columns makes it enumerate their combinations.
    """
    for c in cols or df.columns:
        df = df.where(F.col(c).isNotNull())
    return df


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text that is not a number becomes null; so does NaN."""
    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x).alias(c)
    return df.select(*[number(c) if c in cols else F.col(c) for c in df.columns])


def _apply(df: DataFrame, keys, cols, pos, size, rule) -> DataFrame:
    around = known_neighbours(df, keys, cols, pos, size)
    return around.select(*[rule(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _ramp(at: Column, x0: Column, a0: Column, x1: Column, a1: Column) -> Column:
    return x0 + (x1 - x0) * (at - a0) / (a1 - a0)


def fill_forward(df: DataFrame, cols: Sequence[str], *, limit: int | None = 60,
                 keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """A null takes the last known value at most ``limit`` positions back."""
    def rule(c: str) -> Column:
        prev = F.col(f"_prev_{c}")
        near = F.lit(True) if limit is None else F.col(pos) - prev["at"] <= limit
        return F.when(near, prev["v"])
    return _apply(df, keys, cols, pos, size, rule)


def fill_backward(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = (),
                  pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """A null takes the next known value."""
    return _apply(df, keys, cols, pos, size, lambda c: F.col(f"_next_{c}")["v"])


def fill_linear(df: DataFrame, cols: Sequence[str], *, edges: str = "both",
                keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Straight line between known neighbours.

    Trailing nulls take the last value. Leading nulls take the first value with
    ``edges='both'`` and stay null with ``edges='trailing'``.
    """
    if edges not in ("both", "trailing"):
        raise ValueError(f"unknown edges {edges!r}")

    def rule(c: str) -> Column:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        lead = nxt["v"] if edges == "both" else F.lit(None).cast("double")
        line = _ramp(F.col(pos), prev["v"], prev["at"], nxt["v"], nxt["at"])
        return (F.when(prev.isNull(), lead).when(nxt.isNull(), prev["v"])
                .when(prev["at"] == nxt["at"], prev["v"]).otherwise(line))
    return _apply(df, keys, cols, pos, size, rule)


def fill_missing(df: DataFrame, cols: Sequence[str], *, limit: int = 60,
                 keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Forward fill up to ``limit``, then a line to the next value, then the edges.

    After the forward fill the line starts at the last filled position, so both steps
    follow from the two known neighbours and need a single window pass.
    """
    return _apply(df, keys, cols, pos, size, lambda c: held_then_line(c, limit, pos))


def held_then_line(c: str, limit: int, pos: str) -> Column:
    """The value of :func:`fill_missing` from the known neighbours ``_prev_<c>`` and ``_next_<c>``."""
    prev, nxt, at = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(pos)
    held = prev["at"] + limit
    line = _ramp(at, prev["v"], held, nxt["v"], nxt["at"])
    return (F.when(prev.isNull(), nxt["v"])
            .when(nxt.isNull() | (at <= held), prev["v"]).otherwise(line))


def fill_missing_by_time(df: DataFrame, cols: Sequence[str], *, hold_seconds: int = 3600,
                         keys: Sequence[str] = (), seconds: str = "seconds",
                         size: int = 86400 * 7) -> DataFrame:
    """:func:`fill_missing` with distances in time; ``seconds`` is unique per series."""
    return fill_missing(df, cols, limit=hold_seconds, keys=keys, pos=seconds, size=size)


def remove_outliers(df: DataFrame, value: str, *, threshold: float = 5.0,
                    keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Null values beyond ``threshold`` standard deviations, then interpolate them."""
    scored = attach(df, series_stats(df, value, keys=keys), keys)
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))
    kept = F.when(F.coalesce(F.abs(z) <= threshold, F.lit(True)), F.col(value))
    masked = scored.select(*[kept.alias(c) if c == value else F.col(c) for c in df.columns])
    return fill_linear(masked, [value], edges="trailing", keys=keys, pos=pos, size=size)


def untimed(df: DataFrame, *, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Rows without a time per series: they have no place in it, and :func:`clean_raw` drops them."""
    return df.groupBy(*keys).agg(F.count_if(F.col(time).isNull()).alias("untimed"))


def clean_raw(df: DataFrame, measures: Sequence[str], *, freq: str = "H", value: str = TARGET,
              keys: Sequence[str] = (), time: str = "ts", tie: Sequence[str] = (), size: int = ROW_CHUNK) -> DataFrame:
    """Raw readings to a clean regular table.

    Drop rows without a time (:func:`untimed` counts them) and sparse rows, fill, remove outliers, resample, fill again.
    Fills count rows, so the readings get their global row order first; ``tie`` orders rows of equal time, and fills work
    on chunks of ``size`` rows. Every step reads its input more than once, so the ordered, filled and resampled rows are each
    written to the shared folder: this operator runs jobs when called.
    """
    rows = drop_sparse_rows(df.where(F.col(time).isNotNull()), measures).select(*keys, time, *tie, *measures)
    ordered = with_row_ordinal(rows, keys, [time, *tie])
    filled = materialise(fill_missing(ordered.drop("rows", *tie), measures, keys=keys, pos="ord", size=size))
    smooth = remove_outliers(filled, value, keys=keys, pos="ord", size=size)
    step = resample_hourly if freq == "H" else resample_daily
    stepped = materialise(step(smooth, measures, keys=keys, time=time, span=filled))
    return fill_missing(stepped, measures, keys=keys)


def clean_regular(df: DataFrame, measures: Sequence[str], *, keys: Sequence[str] = (),
                  pos: str = "slot") -> DataFrame:
    """Light pass for tables on a regular grid: fill, coerce, fill what coercion nulled."""
    numbers = coerce_numeric(df, measures)
    return fill_missing(numbers, measures, keys=keys, pos=pos)
