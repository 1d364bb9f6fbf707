"""Scoring queries on backtested forecasts over one common test window."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import metrics as m
from gridtide.operators import evaluate as op
from gridtide.operators import forecast, splits
from gridtide.operators.clean import drop_null_rows
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET

BACKTEST = q.HOURLY + """,
back AS (SELECT ts, p AS y, lag(p, 24) OVER (ORDER BY o) AS d, lag(p, 168) OVER (ORDER BY o) AS w FROM hourly),
done AS (SELECT ts, y, d, w, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM back
  WHERE y IS NOT NULL AND d IS NOT NULL AND w IS NOT NULL),
test AS (SELECT * FROM done WHERE i >= floor(n * (1 - 0.2::DOUBLE))),
long AS (SELECT ts, 'naive_day' AS model, y, d AS p FROM test UNION ALL SELECT ts, 'naive_week', y, w FROM test
  UNION ALL SELECT ts, 'blend', y, 0.5 * w + 0.5 * d FROM test)"""
MODELS = ("naive_day", "naive_week", "blend")
FEATURES = {"naive_week": 24, "blend": 50}

SSE, SST = "sum((y - p) * (y - p))", "(var_pop(y) * count(y))"
K = "max(CASE model WHEN 'naive_week' THEN 24 WHEN 'blend' THEN 50 ELSE 1 END)"
EXPR = {"MAE": "avg(abs(y - p))", "RMSE": "sqrt(avg((y - p) * (y - p)))",
        "MAPE": "100 * avg(abs(y - p) / greatest(abs(y), 1e-8))",
        "SMAPE": "100 * avg(abs(y - p) / greatest((abs(y) + abs(p)) / 2, 1e-8))", "R2": f"1 - {SSE} / {SST}",
        "Adj_R2": f"CASE WHEN count(y) <= {K} + 1 THEN 1 - {SSE} / {SST} "
                  f"ELSE 1 - ({SSE} / {SST}) * (count(y) - 1) / (count(y) - {K} - 1) END"}
DIGITS = {"MAE": 4, "RMSE": 4, "MAPE": 2, "SMAPE": 2, "R2": 4, "Adj_R2": 4}
SCORED = (BACKTEST, "scored AS (SELECT model, " + ", ".join(f"round({EXPR[c]}, {DIGITS[c]}) AS {c}" for c in EXPR)
          + " FROM long GROUP BY model)")


def backtest(spark, sf):
    """Test rows of three forecasts, wide, on times all of them cover."""
    wide, models = forecast.backtest(b.hourly_power(spark, sf), TARGET)
    known = drop_null_rows(wide, [TARGET, *models.values()])
    return splits.split_temporal(known).where("split = 'test'"), models


def backtest_long(spark, sf):
    wide, models = backtest(spark, sf)
    return op.long_form(wide, TARGET, models)


def metric_query(name: str, exprs: dict[str, object], sql: dict[str, str]) -> None:
    @query(name, q.sql(BACKTEST, select=(
        "SELECT model, " + ", ".join(q.r(e, 6, c) for c, e in sql.items()) + " FROM long GROUP BY model")))
    def run(spark, sf):
        table = op.scores(backtest_long(spark, sf), {c: fn(F.col("y"), F.col("p")) for c, fn in exprs.items()})
        return table.select("model", *[r(c) for c in exprs])


metric_query("metric_mae_rmse", {"mae": m.mae, "rmse": m.rmse}, {"mae": EXPR["MAE"], "rmse": EXPR["RMSE"]})
metric_query("metric_mape", {"mape": m.mape}, {"mape": EXPR["MAPE"]})
metric_query("metric_smape", {"smape": m.smape}, {"smape": EXPR["SMAPE"]})
metric_query("metric_r2", {"r2": m.r2}, {"r2": EXPR["R2"]})
metric_query("metric_adj_r2", {"adj_r2": lambda y, p: m.adj_r2(y, p, F.lit(1))},
             {"adj_r2": EXPR["Adj_R2"].replace(K, "1")})


def metrics(spark, sf):
    return op.evaluate(backtest_long(spark, sf), FEATURES)


@query("evaluate_models", q.sql(*SCORED, select="SELECT * FROM scored"))
def evaluate_models(spark, sf):
    return metrics(spark, sf)


@query("evaluate_by_series", q.sql(
    q.BY_TYPE, "back AS (SELECT series_id, ts, p AS y, lag(p, 24) OVER w AS d, lag(p, 168) OVER w AS w FROM typed "
    "WINDOW w AS (PARTITION BY series_id ORDER BY o))",
    "long AS (SELECT series_id, 'naive_day' AS model, y, d AS p FROM back WHERE y + d + w IS NOT NULL UNION ALL "
    "SELECT series_id, 'naive_week', y, w FROM back WHERE y + d + w IS NOT NULL UNION ALL "
    "SELECT series_id, 'blend', y, 0.5 * w + 0.5 * d FROM back WHERE y + d + w IS NOT NULL)",
    select="SELECT series_id, model, " + ", ".join(
        f"round({EXPR[c].replace(K, '1')}, {DIGITS[c]}) AS {c}" for c in EXPR) + " FROM long GROUP BY ALL"))
def evaluate_by_series(spark, sf):
    wide, models = forecast.backtest(b.hourly_by_type(spark, sf), TARGET, keys=b.BY_TYPE)
    table = op.long_form(wide, TARGET, models, keys=b.BY_TYPE)
    return op.evaluate(table, by=("series_id", "model"))


@query("evaluate_aligned", q.sql(*SCORED, select="SELECT model, MAE, RMSE FROM scored"))
def evaluate_aligned(spark, sf):
    """The same scores from separate forecast tables joined on time."""
    wide, models = backtest(spark, sf)
    tables = {n: wide.select("ts", F.col(c).alias("p")) for n, c in models.items()}
    return op.evaluate(op.align(b.hourly_power(spark, sf), tables, value=TARGET)).select("model", "MAE", "RMSE")


@query("leaderboard_rmse", q.sql(*SCORED, select=(
    "SELECT *, CAST(row_number() OVER (ORDER BY \"RMSE\", model) AS INTEGER) AS rank, "
    "row_number() OVER (ORDER BY \"RMSE\", model) = 1 AS is_best FROM scored")))
def leaderboard_rmse(spark, sf):
    return op.leaderboard(metrics(spark, sf), "RMSE")


@query("leaderboard_mae", q.sql(*SCORED, select=(
    "SELECT *, 'ok' AS status, CAST(row_number() OVER (ORDER BY \"MAE\", model) AS INTEGER) AS rank, "
    "row_number() OVER (ORDER BY \"MAE\", model) = 1 AS is_best FROM scored UNION ALL "
    "SELECT 'seasonal', NULL, NULL, NULL, NULL, NULL, NULL, 'failed', 4, false")))
def leaderboard_mae(spark, sf):
    """Ranked by MAE; a model without a score is listed last as failed."""
    return op.leaderboard(op.with_failures(metrics(spark, sf), [*MODELS, "seasonal"]), "MAE")


@query("best_model", q.sql(*SCORED, select='SELECT model, "RMSE" FROM scored ORDER BY "RMSE", model LIMIT 1'))
def best_model(spark, sf):
    return op.best_model(metrics(spark, sf))


@query("metrics_long", q.sql(*SCORED, select=" UNION ALL ".join(
    f"SELECT model, '{c}' AS metric, \"{c}\" AS value FROM scored" for c in ("MAE", "RMSE", "MAPE"))))
def metrics_long(spark, sf):
    return op.metrics_long(metrics(spark, sf))


@query("residual_stats", q.sql(BACKTEST, select=(
    "SELECT model, " + ", ".join(f"round({f}(y - p), 6) AS residual_{n}" for n, f in (
        ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM long GROUP BY model")))
def residual_stats(spark, sf):
    return op.residual_stats(backtest_long(spark, sf))


@query("actual_vs_forecast", q.sql(BACKTEST, select=(
    f"SELECT ts, {q.r('y', 6, 'actual')}, {q.r('0.5 * w + 0.5 * d', 6, 'pred')} FROM done WHERE i >= n - 200")))
def actual_vs_forecast(spark, sf):
    table = b.hourly_power(spark, sf)
    wide, _ = forecast.backtest(table, TARGET)
    pairs = op.actual_vs_forecast(table, wide.select("ts", F.col("blend").alias("p")), value=TARGET)
    return pairs.select("ts", r("actual"), r("pred"))
