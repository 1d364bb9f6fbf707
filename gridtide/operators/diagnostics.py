"""Profiles, distributions and autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.splits import tail
from gridtide.plans.chunks import CHUNK, attach, chunk_sql, chunk_window, halo, join_on, own, with_ordinal

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _last_known(df: DataFrame, value: str, n: int | None, keys, pos) -> DataFrame:
    """The last ``n`` known rows of each series, numbered without gaps in ``ord``."""
    known = df.where(F.col(value).isNotNull())
    if n is not None:
        known = tail(known, n, keys=keys, pos=pos)
    return with_ordinal(known, keys, pos)


def centred_mean(df: DataFrame, value: str, window: int, *, keys: Sequence[str] = (),
                 pos: str = "ord", into: str = "ma", size: int = CHUNK) -> DataFrame:
    """Centred moving average; null where the frame is not full.

    An even window spans ``window + 1`` rows with half weight at both ends.
    """
    half = window // 2
    w = chunk_window(keys, pos)
    frame = w.rowsBetween(-half, half)
    if window % 2:
        mean = F.avg(value).over(frame)
    else:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        mean = (F.sum(value).over(frame) - ends / 2) / window
    full = F.count(value).over(frame) == 2 * half + 1
    wide = halo(df, pos, half, half, size).withColumn(into, F.when(full, mean))
    return own(wide, pos, size)


def consumption_overview(daily: DataFrame, value: str, days: int | None = 365, window: int = 7, *,
                         keys: Sequence[str] = (), pos: str = "slot", time: str = "ts") -> DataFrame:
    """The last ``days`` daily means with a centred average computed inside that cut."""
    cut = _last_known(daily, value, days, keys, pos)
    smooth = centred_mean(cut, value, window, keys=keys, into="_ma")
    return smooth.select(*keys, time, F.round(value, 4).alias("value"), F.round("_ma", 4).alias("ma7"))


def load_heatmap(df: DataFrame, value: str, *, digits: int | None = 4, keys: Sequence[str] = (),
                 time: str = "ts") -> DataFrame:
    """Mean per hour (24 rows) and weekday (7 columns) in one aggregation, rounded to ``digits``."""
    rows = df.select(*keys, F.hour(time).alias("hour"), F.weekday(time).alias("_dow"),
                     F.col(value).alias("_v"))
    axis = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    hours = df.select(*keys).distinct().select(*keys, axis) if keys else df.sparkSession.range(1).select(axis)
    cells = rows.unionByName(hours, allowMissingColumns=True).groupBy(*keys, "hour")
    means = [F.avg(F.when(F.col("_dow") == i, F.col("_v"))) for i in range(len(WEEKDAYS))]
    return cells.agg(*[(m if digits is None else F.round(m, digits)).alias(day)
                       for day, m in zip(WEEKDAYS, means)])


def histogram(df: DataFrame, value: str, bins: int = 80, *, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins, the last one closed; empty bins count 0."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    ends = known.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.where("lo IS NOT NULL")
    # as numpy does, a constant column gets a unit range around its value
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    hits = attach(known, ends, keys).groupBy(*keys, F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    axis = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1))).alias("bin"),
                       F.lit(0).cast("long").alias("n"))
    total = hits.unionByName(axis).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return attach(total, ends, keys).select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"), "n")


def kde(df: DataFrame, value: str, points: int = 1000, per_bandwidth: int = 64, reach: float = 39.0, *,
        keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on a regular axis.

    Values are binned ``per_bandwidth`` times finer than the bandwidth, so the number of kernels depends on the value range,
    not the row count. A bin keeps its count and five moments about its middle; with as many terms of the kernel's series
    the sum equals the direct one over all values but for about 1e-13. Each bin reaches the axis points within ``reach``
    bandwidths; beyond 39 the kernel underflows to 0. A series without spread has no bandwidth and gives no rows.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    stats = known.groupBy(*keys).agg(
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("_x").alias("n"),
        F.stddev_samp("_x").alias("s"))
    span = F.col("hi") - F.col("lo")
    stats = stats.where("s > 0").select(
        *keys, "n", "lo", (F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"),
        (F.col("lo") - 0.5 * span).alias("x0"), (2 * span / (points - 1)).alias("dx"))
    placed = attach(known, stats, keys).withColumn("_b", F.floor((F.col("_x") - F.col("lo")) / (F.col("h") / per_bandwidth)))
    off = (F.col("_x") - F.col("lo")) / F.col("h") - (F.col("_b") + 0.5) / per_bandwidth
    bins = placed.withColumn("_d", off).groupBy(*keys, "_b").agg(*[F.sum(F.pow("_d", F.lit(k))).alias(f"_m{k}") for k in range(6)])
    near = attach(bins, stats, keys).withColumn("_m", F.col("lo") + (F.col("_b") + 0.5) / per_bandwidth * F.col("h"))
    first = F.greatest(F.ceil((F.col("_m") - reach * F.col("h") - F.col("x0")) / F.col("dx")), F.lit(0))
    last = F.least(F.floor((F.col("_m") + reach * F.col("h") - F.col("x0")) / F.col("dx")), F.lit(points - 1))
    met = near.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    met = met.withColumn("_u", (F.col("x0") + F.col("point") * F.col("dx") - F.col("_m")) / F.col("h"))
    u = F.col("_u")
    terms = [F.lit(1.0), u]
    for k in range(1, 5):  # the kernel's derivatives over itself (Hermite polynomials)
        terms.append(u * terms[k] - k * terms[k - 1])
    series = sum((F.col(f"_m{k}") * terms[k] / math.factorial(k) for k in range(1, 6)), F.col("_m0"))
    height = series * F.exp(-0.5 * u * u) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    parts = met.select(*keys, "point", height.alias("_d"))
    axis = stats.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1))).alias("point"),
                        F.lit(0.0).alias("_d"))
    curve = parts.unionByName(axis).groupBy(*keys, "point").agg(F.sum("_d").alias("density"))
    return attach(curve, stats, keys).select(
        *keys, "point", (F.col("x0") + F.col("point") * F.col("dx")).alias("x"), "density").where("x IS NOT NULL")


def seasonal_decompose(df: DataFrame, value: str, period: int = 7, last: int | None = None, *,
                       keys: Sequence[str] = (), pos: str = "slot", time: str = "ts") -> DataFrame:
    """Additive trend, seasonal and residual parts of the known rows, or of the ``last`` of them."""
    cut = _last_known(df, value, last, keys, pos)
    trended = centred_mean(cut, value, period, keys=keys, into="trend").withColumn(
        "_phase", F.col("ord") % period)
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    level = phases.groupBy(*keys).agg(F.avg("_p").alias("_level"))
    seasonal = attach(phases, level, keys).select(*keys, "_phase", (F.col("_p") - F.col("_level")).alias("seasonal"))
    return join_on(trended, seasonal, keys, ["_phase"]).select(
        *keys, time, F.col(value).alias("observed"), "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def _melt(one: DataFrame, keys: Sequence[str], names: dict[int, str], label: str, value: str) -> DataFrame:
    pairs = ", ".join(f"struct({k} AS {label}, {c} AS {value})" for k, c in names.items())
    return one.selectExpr(*keys, f"inline(array({pairs}))")


def acf(df: DataFrame, value: str, lags: int = 48, last: int | None = None, *,
        keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Autocorrelation with one mean and one variance for all lags; one shuffle.

    Of all known rows, or of the ``last`` of them. Null at every lag for a series without spread.
    """
    cut = _last_known(df, value, last, keys, pos).select(*keys, "ord", F.col(value).alias("_x"))
    mean = cut.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    centred = attach(cut, mean, keys).withColumn("_x", F.col("_x") - F.col("_mean"))
    over = chunk_sql(keys, "ord")
    wide = halo(centred, "ord", lags, size=size).selectExpr(
        *keys, "ord", "_chunk", "_x", *[f"lag(_x, {k}) OVER ({over}) AS _l{k}" for k in range(1, lags + 1)])
    one = own(wide, "ord", size).groupBy(*keys).agg(
        F.expr("try_divide(sum(_x * _x), sum(_x * _x)) AS _r0"),
        *[F.expr(f"try_divide(coalesce(sum(_x * _l{k}), 0D), sum(_x * _x)) AS _r{k}")
          for k in range(1, lags + 1)])
    return _melt(one, keys, {k: f"_r{k}" for k in range(lags + 1)}, "lag", "acf")


def pacf(df: DataFrame, value: str, lags: int = 48, last: int | None = None, *,
         keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """Partial autocorrelation (Yule-Walker) from the ``lags + 1`` numbers of :func:`acf`."""
    def levinson_durbin(r: np.ndarray) -> np.ndarray:
        out, phi = [1.0], np.empty(0)
        for k in range(1, len(r)):
            new = (r[k] - phi @ r[k - 1:0:-1]) / (1 - phi @ r[1:k])
            phi = np.append(phi - new * phi[::-1], new)
            out.append(new)
        return np.array(out)

    curve = acf(df, value, lags, last, keys=keys, pos=pos)
    ordered = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    per_series = curve.groupBy(*keys).agg(F.transform(ordered, lambda e: e["acf"]).alias("r"))

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda r: levinson_durbin(np.asarray(r, dtype=float)))

    return per_series.select(*keys, F.posexplode(solve("r")).alias("lag", "pacf"))


def correlation(df: DataFrame, target: str, cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each column with the target, in one pass; null without spread."""
    def pearson(c: str) -> Column:
        r = F.corr(F.col(c).cast("double"), F.col(target))
        return F.when(~F.isnan(r), r).alias(c)
    one = df.groupBy(*keys).agg(*[pearson(c) for c in cols])
    return one.unpivot(list(keys), list(cols), "feature", "corr").orderBy(F.desc_nulls_last(F.abs("corr")))


# Lags of the autocorrelation table.
TABLE_LAGS = (1, 2, 6, 12, 24, 48, 168)


def lag_autocorrelation(df: DataFrame, value: str, lags: Sequence[int] = TABLE_LAGS, *,
                        keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Pearson correlation of the series with its own lags, means taken per overlap."""
    over = chunk_sql(keys, pos)
    wide = halo(df.select(*keys, pos, value), pos, max(lags), size=size).selectExpr(
        "*", *[f"lag(`{value}`, {k}) OVER ({over}) AS _l{k}" for k in lags])
    one = own(wide, pos, size).groupBy(*keys).agg(
        *[F.corr(value, f"_l{k}").alias(f"_r{k}") for k in lags])
    return _melt(one, keys, {k: f"_r{k}" for k in lags}, "lag", "autocorr")
