"""Z-score anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.quality import series_stats
from gridtide.operators.splits import last_days, stride
from gridtide.plans.chunks import attach, with_ordinal

Z_LIMIT = 3.0


def zscores(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Known rows with ``z_score``; null when the series has no spread."""
    known = df.where(F.col(value).isNotNull())
    scored = attach(known, series_stats(known, value, keys=keys), keys)
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))
    return scored.withColumn("z_score", z).drop("_mean", "_std")


def detect(df: DataFrame, value: str, *, threshold: float = Z_LIMIT,
           keys: Sequence[str] = ()) -> DataFrame:
    """Rows further than ``threshold`` standard deviations from the series mean."""
    return zscores(df, value, keys=keys).where(F.abs("z_score") > threshold)


def detect_last_days(df: DataFrame, value: str, days: int, *, threshold: float = Z_LIMIT,
                     keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Anomalies of the whole history that fall in the last ``days`` days of known rows."""
    known = df.where(F.col(value).isNotNull())
    return last_days(detect(df, value, threshold=threshold, keys=keys), days, keys=keys,
                     time=time, until=known)


def severity(z: Column) -> Column:
    """Grade of a z-score as displayed, rounded to two digits."""
    size = F.abs(F.round(z, 2))
    return (F.when(size > 6, "Critical").when(size > 5, "High")
            .when(size > 4, "Medium").otherwise("Low"))


def direction(z: Column, value: Column | None = None, threshold: float | None = None) -> Column:
    """Spike or Drop: by the sign of z, or by ``value > threshold`` when a threshold is given."""
    up = z > 0 if threshold is None else value > threshold
    return F.when(up, "Spike").otherwise("Drop")


def event_log(df: DataFrame, value: str, *, threshold: float = Z_LIMIT,
              spike_above: float | None = None, keys: Sequence[str] = (), pos: str = "slot",
              time: str = "ts") -> DataFrame:
    """Anomalies numbered by time with rounded value, severity and direction."""
    found = detect(df, value, threshold=threshold, keys=keys)
    return with_ordinal(found, keys, pos).select(
        *keys, (F.col("ord") + 1).alias("event_no"), time,
        F.round(value, 4).alias("value"), F.round("z_score", 2).alias("z_score"),
        severity(F.col("z_score")).alias("severity"),
        direction(F.col("z_score"), F.round(value, 4), spike_above).alias("type"))


def rate(df: DataFrame, value: str, *, threshold: float = Z_LIMIT, sampled_step: int | None = None,
         keys: Sequence[str] = ()) -> DataFrame:
    """Anomalies per row in percent.

    The denominator is the row count; ``sampled_step`` divides by the number of rows a
    stride sample would keep instead, as the dashboard display does.
    """
    rows = F.count(F.lit(1))
    base = rows if sampled_step is None else F.ceil(rows / sampled_step)
    hits = F.count(F.when(F.abs("z_score") > threshold, 1))
    return zscores(df, value, keys=keys).groupBy(*keys).agg(
        hits.alias("anomalies"), base.cast("long").alias("base_rows"),
        F.round(100.0 * hits / base, 2).alias("rate_pct"))


def overlay(df: DataFrame, value: str, days: int = 0, *, threshold: float = Z_LIMIT, step: int = 1,
            keys: Sequence[str] = (), pos: str = "slot", time: str = "ts") -> DataFrame:
    """The series and all anomalies of the window, told apart by ``kind``.

    ``step`` keeps every so many rows of the series; the dashboard shows every 6th up to two years, else every 12th.
    """
    known = df.where(F.col(value).isNotNull())
    thin = last_days(known, days, keys=keys, time=time)
    if step > 1:
        thin = stride(thin, step, keys=keys, pos=pos)
    found = detect_last_days(df, value, days, threshold=threshold, keys=keys, time=time)
    series = thin.select(*keys, F.lit("series").alias("kind"), time, F.round(value, 4).alias("value"),
                         F.lit(None).cast("double").alias("z_score"))
    marks = found.select(*keys, F.lit("anomaly").alias("kind"), time,
                         F.round(value, 4).alias("value"), F.round("z_score", 2).alias("z_score"))
    return series.unionByName(marks)
