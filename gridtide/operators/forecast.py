"""Seasonal-blend forecasts, which need no fitted model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.operators.features import add_history
from gridtide.operators.splits import tail
from gridtide.plans.chunks import CHUNK, join_on
from gridtide.plans.slots import slot_time

# Weight of the same hour last week against the same hour yesterday.
WEEK_WEIGHT = {"arima": 0.7, "xgboost": 0.5, "lstm": 0.4}
WEEK, DAY = 168, 24


def _normal(seed: int, *cols: Column) -> Column:
    """A standard normal number that depends only on ``seed`` and ``cols``."""
    def uniform(salt: int) -> Column:
        bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 40))
        return (bits + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def blend(df: DataFrame, value: str, model: str = "xgboost", steps: int = 48, *, freq: str = "H",
          keys: Sequence[str] = (), pos: str = "slot", noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Weighted mix of last week's and yesterday's values, repeated ahead.

    Each series is reduced to an array of its last week (168 numbers at most), then unfolds
    into ``steps`` rows. ``noise`` is relative and off by default.
    """
    weight = WEEK_WEIGHT.get(model, WEEK_WEIGHT["lstm"])
    recent = tail(df.where(F.col(value).isNotNull()).select(*keys, pos, value), WEEK, keys=keys, pos=pos)
    week = F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda e: e[value])
    ends = recent.groupBy(*keys).agg(week.alias("_week"), F.max(pos).alias("_end")).where("_end IS NOT NULL")
    ahead = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    n = F.size("_week")
    day = F.least(n, F.lit(DAY))
    last_week = F.get("_week", F.col("step") % n)
    last_day = F.get("_week", n - day + F.col("step") % day)
    v = weight * last_week + (1 - weight) * last_day
    if noise:
        v = v + noise * F.abs(v) * _normal(seed, *[F.col(k) for k in keys], F.col("step"))
    placed = ahead.withColumns({"p": F.greatest(F.lit(0.0), v), "_slot": F.col("_end") + 1 + F.col("step")})
    return placed.select(*keys, "step", slot_time("_slot", freq).alias("ts"), "p")


def with_context(df: DataFrame, value: str, forecast: DataFrame, *, last: int = 48,
                 keys: Sequence[str] = (), pos: str = "slot", time: str = "ts") -> DataFrame:
    """The last actual rows followed by the forecast, told apart by ``kind``."""
    recent = tail(df.where(F.col(value).isNotNull()), last, keys=keys, pos=pos)
    actual = recent.select(*keys, F.lit("actual").alias("kind"), time, F.round(value, 4).alias("value"))
    return actual.unionByName(
        forecast.select(*keys, F.lit("forecast").alias("kind"), time, F.round("p", 4).alias("value")))


def summarise(forecast: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    return forecast.groupBy(*keys).agg(
        F.round(F.min("p"), 3).alias("min_kw"), F.round(F.avg("p"), 3).alias("mean_kw"),
        F.round(F.max("p"), 3).alias("max_kw"))


def band(forecast: DataFrame, *, std: Column | float | None = None) -> DataFrame:
    """Add ``lower`` and ``upper``: 1.96 ``std``, or five percent of the forecast without one."""
    reach = F.col("p") * 0.05 if std is None else 1.96 * (F.lit(std) if isinstance(std, float) else std)
    return forecast.withColumns({"lower": F.col("p") - reach, "upper": F.col("p") + reach})


def backtest(df: DataFrame, value: str, *, keys: Sequence[str] = (), pos: str = "slot",
             size: int = CHUNK) -> tuple[DataFrame, Mapping[str, str]]:
    """Forecasts for past rows on a dense grid: seasonal naive by day and week, and the blend."""
    hist = add_history(df, value, lags=(DAY, WEEK), keys=keys, pos=pos, size=size)
    day, week = F.col(f"{value}_lag_{DAY}"), F.col(f"{value}_lag_{WEEK}")
    wide = hist.withColumns({"naive_day": day, "naive_week": week, "blend": 0.5 * week + 0.5 * day})
    return wide.drop(f"{value}_lag_{DAY}", f"{value}_lag_{WEEK}"), {
        "naive_day": "naive_day", "naive_week": "naive_week", "blend": "blend"}


def ensemble(tables: Mapping[str, DataFrame], weights: Mapping[str, float], *,
             keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Weighted sum of forecast tables (``time``, ``p``) on their common times."""
    out = None
    for i, (name, table) in enumerate(tables.items()):
        part = table.select(*keys, time, (F.col("p") * weights[name]).alias(f"_p{i}"))
        out = part if out is None else join_on(out, part, keys, [time])
    total = sum((F.col(f"_p{i}") for i in range(1, len(tables))), F.col("_p0"))
    return out.select(*keys, time, total.alias("p"))
