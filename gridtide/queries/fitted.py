"""Queries that fit models, for one series and for many.

Where a fit has a closed form on these tables (regressions on one lag, a single split, given weights) SQL checks its numbers;
the others are compared with numpy and plain loops in the tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridtide.operators import boosting, clean, evaluate, features, splits, stationarity
from gridtide.operators.seasonal import Order, SeasonalForecaster
from gridtide.operators.sequence import SequenceForecaster
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET
from gridtide.session import materialise, scratch_path
from gridtide.sources import reports

FILLED = (q.HOURLY, q.fill("hourly", "done", ["p"], limit=60))
FILLED_BY_TYPE = (q.BY_TYPE, q.fill("typed", "done", ["p"], limit=60, part="series_id"))


def filled_hours(spark, sf):
    return materialise(clean.fill_missing(b.hourly_power(spark, sf), [TARGET]))


def filled_by_type(spark, sf):
    return materialise(clean.fill_missing(b.hourly_by_type(spark, sf), [TARGET], keys=b.BY_TYPE))


# ---------------------------------------------------------------- trees

def feature_rows(spark, sf):
    return features.feature_table(materialise(clean.fill_missing(b.hourly(spark, sf), b.MEASURES)))


def labelled(spark, sf):
    """Feature rows split by time; the last tenth of the train rows is held out to stop growing."""
    table = splits.split_temporal(feature_rows(spark, sf), val_ratio=0.1)
    return materialise(table.withColumn("held", F.col("split") == "validation"))


def fitted_trees(table) -> boosting.TreeForecaster:
    cols = features.feature_columns(table, not_features=("ts", "slot", "split", "held", "ord", "rows"))
    return boosting.TreeForecaster(cols, TARGET).fit(table.where("split <> 'test'"), "held")


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    table = labelled(spark, sf)
    return fitted_trees(table).predict(table.where("split = 'test'")).select("ts", r(TARGET), r("p"))


@query("gbt_best_iteration")
def gbt_best_iteration(spark, sf):
    model = fitted_trees(labelled(spark, sf))
    rows = [(i, float(err), i == len(model.trees)) for i, err in model.history]
    return spark.createDataFrame(rows, "iteration int, validation_mse double, is_best boolean")


def _fold_forecaster(table, rounds: int) -> boosting.TreeForecaster:
    cols = features.feature_columns(table, not_features=("ts", "slot", "split", "held", "ord", "rows"))
    return boosting.TreeForecaster(cols, TARGET, {"rounds": rounds})


@query("gbt_cv")
def gbt_cv(spark, sf):
    """Five fits without held-out rows, so with a number of rounds of their own."""
    table = feature_rows(spark, sf)
    return boosting.cross_validate(_fold_forecaster(table, 20), table)


@query("gbt_cv_by_series")
def gbt_cv_by_series(spark, sf):
    """Errors per event type of models that all types share."""
    table = features.add_lags(filled_by_type(spark, sf), TARGET, (1, 2, 24), keys=b.BY_TYPE)
    table = materialise(clean.drop_null_rows(table))
    forecaster = boosting.TreeForecaster([f"{TARGET}_lag_{k}" for k in (1, 2, 24)], TARGET, {"rounds": 10, "features_share": 1.0})
    return boosting.cross_validate(forecaster, table, 3, keys=b.BY_TYPE)


@query("gbt_importance")
def gbt_importance(spark, sf):
    """The three kinds of importance of one model."""
    model, out = fitted_trees(labelled(spark, sf)), None
    for kind in ("gain", "weight", "cover"):
        part = model.importance(spark, kind).select(F.lit(kind).alias("kind"), "feature", r("importance"), r("share"))
        out = part if out is None else out.unionByName(part)
    return out


@query("topk_importance")
def topk_importance(spark, sf):
    return splits.top_k(fitted_trees(labelled(spark, sf)).importance(spark), "importance", 15)


@query("model_roundtrip", q.sql(*FILLED, "m AS (SELECT count(*) AS n FROM done)",
                                select="SELECT true AS same_predictions, true AS same_settings, n - 168 - CAST(floor((n - 168) * 0.8) AS BIGINT) AS rows FROM m"))
def model_roundtrip(spark, sf):
    """Whether a model predicts the same, and has the same parameters and history, after saving it."""
    table, path = labelled(spark, sf), scratch_path(spark, "trees")
    model = fitted_trees(table)
    model.save(spark, path)
    again = boosting.TreeForecaster.load(spark, path)
    test = table.where("split = 'test'").select("ts", *model.features)
    both = again.predict(model.predict(test).withColumnRenamed("p", "before"))
    same = (list(again.features), again.target, dict(again.params), again.history) == (list(model.features), model.target, dict(model.params), model.history)
    return both.agg(F.bool_and(F.col("before") == F.col("p")).alias("same_predictions"), F.lit(same).alias("same_settings"), F.count("*").alias("rows"))


STUMP = ("hour", "dayofweek", "day")
GAIN = "pow(greatest(abs({g}) - 0.1, 0), 2) / ({n} + 1)"


@query("gbt_stump", q.sql(*FILLED, """t AS (
  SELECT p, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, day(ts) AS day, avg(p) OVER () - p AS g FROM done)""",
  "l AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS feature, {c} AS x, sum(g) AS g, count(*) AS n FROM t GROUP BY {c}" for i, c in enumerate(STUMP)) + ")",
  """c AS (SELECT place, feature, x, sum(g) OVER (PARTITION BY feature ORDER BY x) AS lg, sum(n) OVER (PARTITION BY feature ORDER BY x) AS ln,
  sum(g) OVER (PARTITION BY feature) AS ag, sum(n) OVER (PARTITION BY feature) AS an FROM l)""",
  "s AS (SELECT *, 0.5 * (" + GAIN.format(g="lg", n="ln") + " + " + GAIN.format(g="ag - lg", n="(an - ln)") + " - " + GAIN.format(g="ag", n="an")
  + ") AS gain FROM c WHERE ln >= 5 AND an - ln >= 5 ORDER BY gain DESC, place, x LIMIT 1)",
  select=f"""SELECT feature, CAST(x AS DOUBLE) AS threshold, {q.r('gain', 5, 'gain')}, CAST(ln AS DOUBLE) AS left_cover, CAST(an - ln AS DOUBLE) AS right_cover,
  {q.r('-sign(lg) * greatest(abs(lg) - 0.1, 0) / (ln + 1)', 5, 'left_value')}, {q.r('-sign(ag - lg) * greatest(abs(ag - lg) - 0.1, 0) / (an - ln + 1)', 5, 'right_value')} FROM s"""))
def gbt_stump(spark, sf):
    """One split over calendar columns, with all rows and features: best gain, covers and penalised leaf values."""
    table = features.add_calendar(filled_hours(spark, sf))
    whole = {"rounds": 1, "depth": 1, "rate": 1.0, "rows_share": 1.0, "features_share": 1.0, "bins": 64}
    nodes = boosting.TreeForecaster(STUMP, TARGET, whole).fit(table).nodes(spark)
    top, left, right = (nodes.where(f"node = {i}") for i in range(3))
    pair = left.select(F.col("cover").alias("left_cover"), F.col("value").alias("left_value"), F.col("tree").alias("t1")).join(
        right.select(F.col("cover").alias("right_cover"), F.col("value").alias("right_value"), F.col("tree").alias("t2")), F.col("t1") == F.col("t2"))
    return top.join(pair, F.col("tree") == F.col("t1")).select(
        "feature", "threshold", r("gain", 5), "left_cover", "right_cover", r("left_value", 5), r("right_value", 5))


# ---------------------------------------------------------------- stationarity

@query("adf_decision")
def adf_decision(spark, sf):
    table = stationarity.adf(filled_hours(spark, sf), TARGET)
    return table.select("rows", "lags", r("statistic"), r("p_value"), r("critical_5pct"), "stationary", "status")


@query("adf_by_series")
def adf_by_series(spark, sf):
    table = stationarity.adf(filled_by_type(spark, sf), TARGET, keys=b.BY_TYPE)
    return table.select("series_id", "rows", "lags", r("statistic"), r("p_value"), r("critical_5pct"), "stationary", "status")


LAGGED = ("d AS (SELECT series_id, o, p, lag(p) OVER s AS x, p - lag(p) OVER s AS d, avg(p) OVER (PARTITION BY series_id) AS m "
          "FROM done WINDOW s AS (PARTITION BY series_id ORDER BY o))")


@query("adf_lag0_by_series", q.sql(*FILLED_BY_TYPE, LAGGED,
    "g AS (SELECT series_id, count(*) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) - regr_sxy(d, x) * regr_sxy(d, x) / regr_sxx(d, x) AS rss "
    "FROM d WHERE x IS NOT NULL GROUP BY series_id)",
    select=(f"SELECT series_id, n + 1 AS rows, 0 AS lags, {q.r('b / sqrt(rss / (n - 2) / sxx)', 5, 'statistic')}, "
            f"{q.r('-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n)', 5, 'critical_5pct')} FROM g")))
def adf_lag0_by_series(spark, sf):
    table = stationarity.adf(filled_by_type(spark, sf), TARGET, 0, keys=b.BY_TYPE)
    return table.select("series_id", "rows", "lags", r("statistic", 5), r("critical_5pct", 5))


@query("lag_products_by_series", q.sql(*FILLED_BY_TYPE, LAGGED,
    "z AS (SELECT series_id, [1.0, x - m, lag(d, 1) OVER s, lag(d, 2) OVER s, d] AS v FROM d WINDOW s AS (PARTITION BY series_id ORDER BY o))",
    "f AS (SELECT series_id, v FROM z WHERE v[4] IS NOT NULL)",
    select=(f"SELECT series_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {q.r('sum(v[i + 1] * v[j + 1])', 4, 'total')} "
            "FROM f, range(5) a(i), range(5) c(j) GROUP BY series_id, i, j")))
def lag_products_by_series(spark, sf):
    """The normal equations of the stationarity test with two lags."""
    table = stationarity.lag_products(filled_by_type(spark, sf), TARGET, 2, keys=b.BY_TYPE)
    return table.select("series_id", "i", "j", r("total", 4))


# ---------------------------------------------------------------- seasonal model

@query("sarima_hr_fit")
def sarima_hr_fit(spark, sf):
    return SeasonalForecaster(TARGET).fit(filled_hours(spark, sf)).summary().select("name", r("value"))


@query("sarima_hr_forecast")
def sarima_hr_forecast(spark, sf):
    return SeasonalForecaster(TARGET).fit(filled_hours(spark, sf)).forecast(48).select("step", "ts", r("p"))


@query("sarima_hr_fitted")
def sarima_hr_fitted(spark, sf):
    table = filled_hours(spark, sf)
    return SeasonalForecaster(TARGET).fit(table).fitted(table).select("ts", r(TARGET), r("p"))


@query("sarima_fit_by_series")
def sarima_fit_by_series(spark, sf):
    """A model of other orders for every event type."""
    order = Order(2, 0, 1, 0, 1, 1, 24)
    return SeasonalForecaster(TARGET, order, b.BY_TYPE).fit(filled_by_type(spark, sf)).summary().select("series_id", "name", r("value"))


@query("ar1_fit_by_series", q.sql(*FILLED_BY_TYPE, LAGGED,
    "g AS (SELECT series_id, count(*) AS n, regr_slope(p, x) AS b, regr_intercept(p, x) AS a, regr_syy(p, x) - regr_sxy(p, x) * regr_sxy(p, x) / regr_sxx(p, x) AS rss "
    "FROM d WHERE x IS NOT NULL GROUP BY series_id)",
    select=" UNION ALL ".join(f"SELECT series_id, '{n}' AS name, {q.r(e, 5, 'value')} FROM g" for n, e in (
        ("constant", "a"), ("ar.L1", "b"), ("n", "n"), ("sigma2", "rss / n"), ("log_likelihood", "-n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1)"),
        ("aic", "n * (ln(2 * pi()) + ln(rss / n) + 1) + 6"), ("bic", "n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n)")))))
def ar1_fit_by_series(spark, sf):
    """Order (1,0,0) with a constant, whose least squares are a regression on the value before."""
    model = SeasonalForecaster(TARGET, Order(1, 0, 0, 0, 0, 0, 1, True), b.BY_TYPE).fit(filled_by_type(spark, sf))
    return model.summary().where("name NOT LIKE '%squares'").select("series_id", "name", r("value", 5))


GIVEN = {"ar.L1": 0.4, "ar.S24": 0.2, "ma.L1": -0.5, "ma.S24": -0.3}


def _given_sql(select: str, steps: int = 0) -> str:
    """Shocks by a recursive query over the hours, and values ahead by one over the steps."""
    order = Order()
    _, ar, sar, ma, sma = order.parts(list(GIVEN.values()))
    values = np.convolve(ar, sar)
    whole, moving = np.convolve(values, order.differences()), np.convolve(ma, sma)
    lagged = lambda poly, c: " + ".join(f"({x!r}::DOUBLE) * lag({c}, {k}, 0) OVER (ORDER BY o)" for k, x in enumerate(poly.tolist()) if x)
    listed = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
    parts = [*FILLED, f"u AS (SELECT o, ts, p, CASE WHEN o >= {order.lost + order.ar_reach} THEN {lagged(whole, 'p')} ELSE 0 END AS u FROM done)",
             f"e AS (SELECT CAST(-1 AS BIGINT) AS o, {listed([0.0] * 25)} AS es UNION ALL SELECT u.o, list_prepend(u.u - list_inner_product({listed(moving[1:].tolist())}, es), es[1:24]) "
             "FROM e JOIN u ON u.o = e.o + 1)"]
    if steps:
        parts += ["y AS (SELECT list(p ORDER BY o DESC)[1:50] AS ys, max(ts) AS t, max(o) AS o FROM done)",
                  f"f AS (SELECT CAST(0 AS BIGINT) AS step, t, ys, es, CAST(0 AS DOUBLE) AS p FROM y JOIN e USING (o) UNION ALL SELECT step + 1, t, list_prepend(v, ys[1:49]), list_prepend(0.0::DOUBLE, es[1:24]), v "
                  f"FROM (SELECT *, list_inner_product({listed(moving[1:].tolist())}, es) - list_inner_product({listed(whole[1:].tolist())}, ys) AS v FROM f WHERE step < {steps}))"]
    return q.sql(*parts, select=select)


@query("sarima_given_shocks", _given_sql(f"SELECT u.ts, {q.r('e.es[1]', 6, 'shock')} FROM e JOIN u USING (o) WHERE o >= 50"))
def sarima_given_shocks(spark, sf):
    """Shocks of a model with given weights, over several chunks."""
    table = filled_hours(spark, sf)
    model = SeasonalForecaster(TARGET, chunk=200).fit(table, list(GIVEN.values()))
    return table.select("ts", "slot").join(model.shocks(table), "slot").select("ts", r("shock"))


@query("sarima_given_forecast", _given_sql(f"SELECT step - 1 AS step, t + step * INTERVAL 1 HOUR AS ts, {q.r('p', 4, 'p')} FROM f WHERE step > 0", 600))
def sarima_given_forecast(spark, sf):
    """600 steps ahead by a model with given weights."""
    model = SeasonalForecaster(TARGET).fit(filled_hours(spark, sf), list(GIVEN.values()))
    return model.forecast(600).select("step", "ts", r("p", 4))


@query("seasonal_roundtrip")
def seasonal_roundtrip(spark, sf):
    """Forecasts per event type before and after saving and loading."""
    path = scratch_path(spark, "seasonal")
    model = SeasonalForecaster(TARGET, Order(1, 0, 1, 0, 1, 0, 24), b.BY_TYPE, max_steps=3).fit(filled_by_type(spark, sf))
    model.save(path)
    before = model.forecast(24).select("series_id", "step", F.col("p").alias("before"))
    return before.join(SeasonalForecaster.load(spark, path).forecast(24), ["series_id", "step"]).select(
        "series_id", "step", (F.col("before") == F.col("p")).alias("same"))


# ---------------------------------------------------------------- sequence model

def scaled_hours(spark, sf, test_ratio: float = 0.1, table=None):
    """The filled hours scaled by the range of their train rows, and the ranges."""
    table = materialise(splits.split_temporal(filled_hours(spark, sf) if table is None else table, test_ratio))
    ranges = features.value_range(table.where("split = 'train'"), TARGET)
    return materialise(features.scale(table, TARGET, ranges)), ranges


@query("sequence_forecast")
def sequence_forecast(spark, sf):
    """One-step predictions on the last tenth, in the original scale."""
    table, ranges = scaled_hours(spark, sf)
    model = SequenceForecaster("scaled").fit(table.where("split = 'train'"))
    test = model.predict(table).where("split = 'test'")
    return features.unscale(test, "p", ranges, into="pred").select("ts", r(TARGET), r("pred"))


@query("sequence_multistep")
def sequence_multistep(spark, sf):
    table, ranges = scaled_hours(spark, sf)
    ahead = SequenceForecaster("scaled").fit(table.where("split = 'train'")).multi_step(table, 48)
    return features.unscale(ahead, "p", ranges, into="pred").select("step", "ts", r("pred"))


@query("sequence_lag1_by_series", q.sql(*FILLED_BY_TYPE, LAGGED,
    "g AS (SELECT series_id, count(*) AS n, regr_slope(p, x) AS b, regr_intercept(p, x) AS a FROM d WHERE x IS NOT NULL GROUP BY series_id)",
    select=f"SELECT series_id, n + 1 AS rows, {q.r('a', 5, 'constant')}, {q.r('b', 5, 'weight')} FROM g"))
def sequence_lag1_by_series(spark, sf):
    """A loss that never turns linear and one value back: a regression on the value before, per event type."""
    model = SequenceForecaster(TARGET, 1, b.BY_TYPE, delta=1e12, ridge=0.0).fit(filled_by_type(spark, sf), validation=0.0)
    return model.fits.select("series_id", "rows", F.get("weights", 0).alias("constant"), F.get("weights", 1).alias("weight")).select(
        "series_id", "rows", r("constant", 5), r("weight", 5))


@query("training_history")
def training_history(spark, sf):
    """Train and validation losses of every iteration."""
    table, _ = scaled_hours(spark, sf)
    told = SequenceForecaster("scaled").fit(table.where("split = 'train'")).history()
    return told.select("iteration", r("loss"), r("val_loss"), r("mae"), r("val_mae"), r("gradient"))


@query("training_start", q.sql(*FILLED,
    "a AS (SELECT ts, p, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM done)",
    "t AS (SELECT i, p, CAST(floor(n * 0.9) AS BIGINT) AS n FROM a WHERE i < CAST(floor(n * 0.9) AS BIGINT))",
    "s AS (SELECT i - 24 AS i, n - 24 AS m, (p - (SELECT min(p) FROM t)) / (SELECT max(p) - min(p) FROM t) AS x FROM t)",
    "h AS (SELECT i < CAST(floor(m * 0.9) AS BIGINT) AS train, abs(x) AS mae, CASE WHEN abs(x) <= 0.1 THEN 0.5 * x * x ELSE 0.1 * (abs(x) - 0.05) END AS loss FROM s WHERE i >= 0)",
    select=(f"SELECT 0 AS iteration, {q.r('avg(loss) FILTER (train)', 6, 'loss')}, {q.r('avg(loss) FILTER (NOT train)', 6, 'val_loss')}, "
            f"{q.r('avg(mae) FILTER (train)', 6, 'mae')}, {q.r('avg(mae) FILTER (NOT train)', 6, 'val_mae')} FROM h")))
def training_start(spark, sf):
    """Losses of the model that is always 0, on the train and the validation windows."""
    table, _ = scaled_hours(spark, sf)
    told = SequenceForecaster("scaled", max_steps=1).fit(table.where("split = 'train'")).history()
    return told.where("iteration = 0").select("iteration", r("loss"), r("val_loss"), r("mae"), r("val_mae"))


# ---------------------------------------------------------------- comparison

@query("train_and_compare")
def train_and_compare(spark, sf):
    """Seasonal, tree and sequence model fitted on one train range, all scored one step ahead on one test range and ranked.

    A model that fails is a row with its reason; the others keep their scores.
    """
    hours = clean.fill_missing(b.hourly(spark, sf), b.MEASURES)
    table = materialise(splits.split_temporal(hours, val_ratio=0.1))
    test = table.where("split = 'test'").select("ts", TARGET)
    power = materialise(table.select("ts", "slot", TARGET, F.when(F.col("split") == "test", "test").otherwise("train").alias("split")))

    def seasonal():
        model = SeasonalForecaster(TARGET).fit(power.where("split = 'train'"))
        return model.fitted(power).where("split = 'test'").select("ts", "p")

    def boosted():
        rows = features.feature_table(table.drop("split")).join(table.select("ts", "split"), "ts")
        tabular = materialise(rows.withColumn("held", F.col("split") == "validation"))
        return fitted_trees(tabular).predict(tabular.where("split = 'test'")).select("ts", "p")

    def sequence():
        ranges = features.value_range(power.where("split = 'train'"), TARGET)
        scaled = materialise(features.scale(power, TARGET, ranges))
        found = SequenceForecaster("scaled").fit(scaled.where("split = 'train'")).predict(scaled).where("split = 'test'")
        return features.unscale(found, "p", ranges, into="pred").select("ts", F.col("pred").alias("p"))

    makers = {"seasonal": seasonal, "trees": boosted, "sequence": sequence}
    forecasts, reasons = evaluate.attempt(makers)
    metrics = evaluate.evaluate(evaluate.align(test, forecasts, value=TARGET)).withColumn("horizon", F.lit(1))
    return evaluate.leaderboard(evaluate.with_failures(metrics, list(makers), reasons))


@query("fitted_export", q.sql(*FILLED, "a AS (SELECT ts, p, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM done)",
    "t AS (SELECT *, CAST(floor((n - 168) * 0.8) AS BIGINT) + 168 AS cut FROM a)",
    select=f"SELECT ts AS datetime, {q.r('p', 6, 'actual')}, true AS predicted FROM t WHERE i >= cut"))
def fitted_export(spark, sf):
    """Actual and predicted test hours of the fitted trees, written and read as an export file."""
    table, path = labelled(spark, sf), scratch_path(spark, "export")
    found = fitted_trees(table).predict(table.where("split = 'test'"))
    reports.write_csv(found.select(F.col("ts").alias("datetime"), F.col(TARGET).alias("actual"), F.col("p").alias("trees_pred")), path)
    back = spark.read.schema("datetime timestamp_ntz, actual double, trees_pred double").option("header", True).csv(path)
    return back.select("datetime", r("actual"), F.col("trees_pred").isNotNull().alias("predicted"))
