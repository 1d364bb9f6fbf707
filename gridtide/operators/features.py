"""Model features on a regular grid."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.calendar import calendar_parts, cyclical, flags
from gridtide.operators.clean import drop_null_rows, held_then_line
from gridtide.plans.chunks import CHUNK, attach, chunk_sql, chunk_window, halo, own, reaching_neighbours
from gridtide.schemas import SUB_METERS, TARGET

# Default lags and rolling windows, in steps.
LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
WINDOWS = (3, 6, 12, 24, 48)
SAME_TIME = ("occupancy_x_power", "peak_power")  # computed from the target of the same row


def add_calendar(df: DataFrame, time: str = "ts") -> DataFrame:
    """Calendar parts, then flags built on those columns.

    Two steps on purpose: repeating a part's expression inside the flags would make the optimizer
    enumerate every mix of column and expression when it infers filters for a later join.
    """
    parts = df.withColumns(calendar_parts(F.col(time)))
    return parts.withColumns(flags(F.col("hour"), F.col("dayofweek"), F.col("quarter")))


def add_cyclical(df: DataFrame, time: str = "ts") -> DataFrame:
    parts = calendar_parts(F.col(time))
    need = {name: name if name in df.columns else f"_{name}" for name in ("hour", "month", "dayofweek")}
    fresh = {c: parts[name] for name, c in need.items() if c != name}
    wide = df.withColumns(fresh) if fresh else df
    return wide.withColumns(cyclical(*[F.col(c) for c in need.values()])).drop(*fresh)


def history_sql(value: str, lags: Sequence[int], windows: Sequence[int], over: str) -> list[str]:
    """Window expressions over ``over``; rolling ones need all their previous rows known."""
    out = [f"lag(`{value}`, {k}) OVER ({over}) AS `{value}_lag_{k}`" for k in lags]
    for n in windows:
        frame = f"OVER ({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [f"CASE WHEN count(`{value}`) {frame} = {n} THEN {agg}(`{value}`) {frame} END "
                f"AS `{value}_roll_{name}_{n}`"
                for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    return out


def add_history(df: DataFrame, value: str = TARGET, *, lags: Sequence[int] = (),
                windows: Sequence[int] = (), keys: Sequence[str] = (), pos: str = "slot",
                size: int = CHUNK) -> DataFrame:
    """Lag and rolling columns from one halo shuffle and one sort; ``pos`` must be dense."""
    columns = history_sql(value, lags, windows, chunk_sql(keys, pos))
    wide = halo(df, pos, max([*lags, *windows]), size=size).selectExpr("*", *columns)
    return own(wide, pos, size)


def add_filled_history(df: DataFrame, value: str = TARGET, *, fill: Sequence[str], limit: int = 60, lags: Sequence[int] = (),
                       windows: Sequence[int] = (), keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """:func:`fill_missing` on ``fill``, then :func:`add_history`, with one shuffle of the rows and one sort per direction."""
    around = reaching_neighbours(df, keys, fill, pos, max([*lags, *windows]), size)
    filled = around.select(*[held_then_line(c, limit, pos).alias(c) if c in fill else F.col(c) for c in df.columns], "_series", "_chunk")
    columns = history_sql(value, lags, windows, f"PARTITION BY _series, _chunk ORDER BY `{pos}`")
    return own(filled.selectExpr("*", *columns).drop("_series"), pos, size)


def add_lags(df: DataFrame, value: str = TARGET, lags: Sequence[int] = LAGS, **kw) -> DataFrame:
    return add_history(df, value, lags=lags, **kw)


def add_rolling(df: DataFrame, value: str = TARGET, windows: Sequence[int] = WINDOWS, **kw) -> DataFrame:
    return add_history(df, value, windows=windows, **kw)


def add_interactions(df: DataFrame, value: str = TARGET, time: str = "ts") -> DataFrame:
    """Degree hours and products, as far as their inputs are present."""
    new: dict[str, Column] = {}
    if "temperature_c" in df.columns:
        t = F.col("temperature_c")
        hour = F.col("hour") if "hour" in df.columns else F.hour(time)
        new["temp_x_hour"] = t * hour
        new["hdd"] = F.when(t.isNotNull(), F.greatest(F.lit(0.0), 18 - t))
        new["cdd"] = F.when(t.isNotNull(), F.greatest(F.lit(0.0), t - 18))
    if value in df.columns and "occupancy" in df.columns:
        new["occupancy_x_power"] = F.col("occupancy") * F.col(value)
    if value in df.columns and "is_peak_hour" in df.columns:
        new["peak_power"] = F.col("is_peak_hour") * F.col(value)
    return df.withColumns(new) if new else df


def feature_table(df: DataFrame, value: str = TARGET, *, lags: Sequence[int] = LAGS,
                  windows: Sequence[int] = WINDOWS, keys: Sequence[str] = (), time: str = "ts",
                  pos: str = "slot", size: int = CHUNK, fill: Sequence[str] = ()) -> DataFrame:
    """All feature groups; rows with any null are dropped. Columns in ``fill`` are filled first, in the same shuffle.

    The other groups are null only where an input is, so the drop comes right after the history
    columns, before the optimizer would have to reason about derived expressions.
    """
    if fill:
        history = add_filled_history(df, value, fill=fill, lags=lags, windows=windows, keys=keys, pos=pos, size=size)
    else:
        history = add_history(df, value, lags=lags, windows=windows, keys=keys, pos=pos, size=size)
    known = drop_null_rows(history)
    return add_interactions(add_cyclical(add_calendar(known, time), time), value, time)


def feature_columns(df: DataFrame, value: str = TARGET, *, leak_safe: bool = True,
                    not_features: Sequence[str] = ("ts", "slot")) -> list[str]:
    """Model inputs. ``leak_safe`` leaves out columns that contain the target of the same time."""
    out = [c for c in df.columns if c != value and c not in not_features]
    if leak_safe:
        out = [c for c in out if c not in SAME_TIME and c not in SUB_METERS]
    return out


# The calendar columns the feature report counts.
CALENDAR_REPORT = ("hour", "dayofweek", "month", "season", "is_weekend", "is_peak_hour")


def feature_group(name: str) -> str:
    if re.search(r"_lag_\d+$", name):
        return "lag"
    if re.search(r"_roll_(mean|std|min|max)_\d+$", name):
        return "rolling"
    if name in CALENDAR_REPORT:
        return "calendar"
    if name.endswith(("_sin", "_cos")):
        return "cyclical"
    return "other"


def feature_catalog(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Each feature with its group, position, leak flag and known-value count."""
    names = feature_columns(df, value, leak_safe=False)
    safe = set(feature_columns(df, value))
    facts = [(i, c, feature_group(c), c in safe) for i, c in enumerate(names)]
    listed = df.sparkSession.createDataFrame(
        facts, "position int, feature string, feature_group string, leak_safe boolean")
    counts = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "known_rows")
    return listed.join(F.broadcast(counts), "feature")  # one row per column on both sides


def sequences(df: DataFrame, value: str, look_back: int = 24, *, keys: Sequence[str] = (),
              pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """The previous ``look_back`` values as an array in time order, with the value as ``y``."""
    frame = chunk_window(keys, pos).rowsBetween(-look_back, -1)
    others = [c for c in df.columns if c not in ("x", "y")]
    wide = halo(df, pos, look_back, size=size).select(
        *others, "_chunk", F.collect_list(value).over(frame).alias("x"), F.col(value).alias("y"))
    return own(wide, pos, size).where((F.size("x") == look_back) & F.col("y").isNotNull())


def value_range(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _span() -> Column:
    return F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))


def scale(df: DataFrame, value: str, ranges: DataFrame, *, keys: Sequence[str] = (),
          into: str = "scaled") -> DataFrame:
    """Min-max scaling to [0, 1]; a constant column becomes 0."""
    wide = attach(df, ranges, keys).withColumn(into, (F.col(value) - F.col("lo")) / _span())
    return wide.drop("lo", "hi")


def unscale(df: DataFrame, scaled: str, ranges: DataFrame, *, keys: Sequence[str] = (),
            into: str = "value") -> DataFrame:
    wide = attach(df, ranges, keys).withColumn(into, F.col(scaled) * _span() + F.col("lo"))
    return wide.drop("lo", "hi")
