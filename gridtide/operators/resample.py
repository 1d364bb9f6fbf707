"""Regular grids from irregular readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.plans.chunks import CHUNK
from gridtide.plans.slots import slot_of, slot_time
from gridtide.schemas import SUB_METERS


def ticks(extents: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """One row per series and slot between ``lo`` and ``hi``.

    Chunks are spread over the cluster before they unfold, so a long series or many
    series never unfold inside one task.
    """
    spread = max(extents.sparkSession.sparkContext.defaultParallelism, 1)
    chunks = extents.selectExpr(
        *keys, "lo", "hi", f"explode(sequence(floor(lo / {size}), floor(hi / {size}))) AS _chunk",
    ).repartition(spread, *keys, "_chunk")
    first, last = f"greatest(lo, _chunk * {size})", f"least(hi, _chunk * {size} + {size - 1})"
    return chunks.selectExpr(*keys, f"explode(sequence({first}, {last})) AS slot")


def extents(df: DataFrame, freq: str, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """First and last slot (``lo``, ``hi``) of each series."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_z")).where("_a IS NOT NULL")
    return ends.select(*keys, slot_of("_a", freq).alias("lo"), slot_of("_z", freq).alias("hi"))


def resample(df: DataFrame, freq: str, *, keys: Sequence[str] = (), means: Sequence[str] = (),
             sums: Sequence[str] = (), time: str = "ts", grid: bool = True,
             empty_sum: str = "zero", span: DataFrame | None = None) -> DataFrame:
    """Mean or sum per time step, as ``keys, slot, ts, measures``.

    ``grid`` keeps empty steps between the first and last one: the empty steps join the
    readings as rows without values, so partial aggregation and one shuffle do it all.
    ``empty_sum`` is the sum of a step without values: 'zero' or 'null'. ``span`` is a table with
    the same keys and times that is cheaper to read for the first and last step.
    """
    if empty_sum not in ("zero", "null"):
        raise ValueError(f"unknown empty_sum {empty_sum!r}")
    measures = [*means, *sums]
    rows = df.where(F.col(time).isNotNull()).select(
        *keys, slot_of(time, freq).alias("slot"), *measures)
    if grid:
        rows = rows.unionByName(ticks(extents(df if span is None else span, freq, keys, time), keys),
                                allowMissingColumns=True)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0)) if empty_sum == "zero" else F.sum(c)

    exprs = {c: F.avg(c).alias(c) for c in means} | {c: total(c).alias(c) for c in sums}
    if not exprs:
        return rows.select(*keys, "slot").distinct().select(
            *keys, "slot", slot_time("slot", freq).alias("ts"))
    stepped = rows.groupBy(*keys, "slot").agg(*[exprs[c] for c in measures])
    return stepped.select(*keys, "slot", slot_time("slot", freq).alias("ts"), *measures)


def resample_hourly(df: DataFrame, measures: Sequence[str], *, keys: Sequence[str] = (),
                    time: str = "ts", empty_sum: str = "zero",
                    span: DataFrame | None = None) -> DataFrame:
    """Hourly means; sub-meter columns are energy and add up."""
    sums = [c for c in measures if c in SUB_METERS]
    means = [c for c in measures if c not in SUB_METERS]
    return resample(df, "H", keys=keys, means=means, sums=sums, time=time,
                    empty_sum=empty_sum, span=span).select(*keys, "slot", "ts", *measures)


def resample_daily(df: DataFrame, measures: Sequence[str], *, keys: Sequence[str] = (),
                   time: str = "ts", span: DataFrame | None = None) -> DataFrame:
    """Daily means of every column."""
    return resample(df, "D", keys=keys, means=measures, time=time, span=span)


def time_grid(df: DataFrame, freq: str, *, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Every step from the first to the last reading of each series."""
    grid = ticks(extents(df, freq, keys, time), keys)
    return grid.select(*keys, "slot", slot_time("slot", freq).alias("ts"))


def daily_mean(df: DataFrame, value: str, *, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Daily mean of one column; days without a value are absent."""
    daily = resample(df, "D", keys=keys, means=[value], time=time, grid=False)
    return daily.where(F.col(value).isNotNull())
