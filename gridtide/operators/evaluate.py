"""Scoring of forecasts. Long form: ``keys, ts, model, y, p``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import metrics as m
from gridtide.operators.splits import tail
from gridtide.plans.chunks import join_on
from gridtide.session import materialise


def long_form(wide: DataFrame, actual: str, models: Mapping[str, str], *,
              keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """One row per time and model, only for times every model has a forecast for."""
    complete = wide.where(F.col(actual).isNotNull())
    for c in models.values():
        complete = complete.where(F.col(c).isNotNull())
    pairs = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p"))
                      for name, c in models.items()])
    return complete.select(*keys, time, F.col(actual).alias("y"), F.explode(pairs).alias("_e")).select(
        *keys, time, "_e.model", "y", "_e.p")


def align(actual: DataFrame, forecasts: Mapping[str, DataFrame], *, value: str,
          keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Forecast tables (``time``, ``p``) with the actuals, at the times that every model with any forecast has one for.

    A model without forecasts has no rows and leaves the others theirs.
    """
    told = None
    for name, table in forecasts.items():
        part = table.where(F.col("p").isNotNull()).select(*keys, time, F.lit(name).alias("model"), F.col("p").cast("double").alias("p"))
        told = part if told is None else told.unionByName(part)
    if told is None:
        raise ValueError("no forecasts to align")
    known = actual.where(F.col(value).isNotNull()).select(*keys, time, F.col(value).alias("y"))
    long = join_on(told, known, keys, [time]).select(*keys, time, "model", "y", "p")
    alive = told.agg(F.count_distinct("model")).scalar()
    common = long.groupBy(*keys, time).agg(F.count_distinct("model").alias("_m")).where(F.col("_m") == alive).drop("_m")
    return join_on(long, common, keys, [time])


def attempt(makers: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Written forecasts of the models that could be fitted, and the reasons of those that could not.

    A model's failure is a row of the comparison, so any error of its own fit is caught here.
    """
    forecasts, reasons = {}, {}
    for name, make in makers.items():
        try:
            forecasts[name] = materialise(make(), "forecast")
        except Exception as e:  # noqa: BLE001
            reasons[name] = f"{type(e).__name__}: {e}".splitlines()[0][:200]
    return forecasts, reasons


def scores(df: DataFrame, wanted: Mapping[str, Column], *, by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in wanted.items()])


def evaluate(df: DataFrame, n_features: Mapping[str, int] | int = 1, *,
             by: Sequence[str] = ("model",)) -> DataFrame:
    """All metrics per model in one aggregation, rounded for display."""
    y, p = F.col("y"), F.col("p")
    if isinstance(n_features, int):
        k = F.lit(n_features)
    else:
        row_k = F.lit(1)
        for name, n in n_features.items():
            row_k = F.when(F.col("model") == name, F.lit(n)).otherwise(row_k)
        k = F.max(row_k)
    return scores(df, {
        "MAE": F.round(m.mae(y, p), 4), "RMSE": F.round(m.rmse(y, p), 4),
        "MAPE": F.round(m.mape(y, p), 2), "SMAPE": F.round(m.smape(y, p), 2),
        "R2": F.round(m.r2(y, p), 4), "Adj_R2": F.round(m.adj_r2(y, p, k), 4)}, by=by)


def with_failures(metrics: DataFrame, expected: Sequence[str], reasons: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``status``; an expected model without a score is a failed row with null metrics. ``reasons`` adds ``reason``."""
    rows = [(n, (reasons or {}).get(n)) for n in expected]
    names = metrics.sparkSession.createDataFrame(rows, "model string, reason string")
    full = (names if reasons is not None else names.drop("reason")).join(metrics, "model", "full")
    return full.withColumn("status", F.when(F.col("MAE").isNull(), "failed").otherwise("ok"))


def leaderboard(metrics: DataFrame, by: str = "RMSE") -> DataFrame:
    """Models ranked by an error, missing scores last. The table has one row per model."""
    order = Window.orderBy(F.asc_nulls_last(by), "model")
    place = F.row_number().over(order)
    return metrics.withColumns({"rank": place, "is_best": place == 1}).orderBy("rank")


def best_model(metrics: DataFrame, by: str = "RMSE") -> DataFrame:
    """The model with the smallest error; a missing error counts as infinite."""
    error = F.coalesce(F.col(by), F.lit(float("inf")))
    best = F.min(F.struct(error.alias("e"), F.col("model")))
    return metrics.agg(best["model"].alias("model"), best["e"].alias(by))


def metrics_long(metrics: DataFrame, names: Sequence[str] = ("MAE", "RMSE", "MAPE")) -> DataFrame:
    return metrics.unpivot(["model"], list(names), "metric", "value")


def residual_stats(df: DataFrame, *, by: Sequence[str] = ("model",)) -> DataFrame:
    e = F.col("y") - F.col("p")
    return scores(df, {"residual_mean": F.round(F.avg(e), 6), "residual_std": F.round(F.stddev_pop(e), 6),
                       "residual_min": F.round(F.min(e), 6), "residual_max": F.round(F.max(e), 6)}, by=by)


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame, *, value: str, last: int = 200,
                       keys: Sequence[str] = (), time: str = "ts", pos: str = "slot") -> DataFrame:
    """The last rows of both tables, paired by time."""
    pairs = join_on(actual.select(*keys, pos, time, F.col(value).alias("actual")),
                    forecast.select(*keys, time, F.col("p").alias("pred")), keys, [time])
    known = pairs.where("actual IS NOT NULL AND pred IS NOT NULL")
    return tail(known, last, keys=keys, pos=pos).select(*keys, time, "actual", "pred")
