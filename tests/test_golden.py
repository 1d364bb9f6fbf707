"""Hand-derived vectors."""

import math

import pytest
from pyspark.sql import functions as F

from gridtide.operators import anomalies, clean, diagnostics, evaluate, features, forecast, quality, splits
from gridtide.operators.resample import resample, time_grid

N = None
GAPPY = [N, N, 1, N, N, N, N, N, 7, N, N]


def col(df, name="x", order="slot"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_forward_then_linear(series):
    df = series(GAPPY)
    assert col(clean.fill_forward(df, ["x"], limit=2)) == [N, N, 1, 1, 1, N, N, N, 7, 7, 7]
    assert col(clean.fill_missing(df, ["x"], limit=2)) == [1, 1, 1, 1, 1, 2.5, 4, 5.5, 7, 7, 7]
    two_steps = clean.fill_linear(clean.fill_forward(df, ["x"], limit=2), ["x"])
    assert col(two_steps) == col(clean.fill_missing(df, ["x"], limit=2))


def test_linear_edges(series):
    assert col(clean.fill_linear(series(GAPPY), ["x"], edges="trailing")) == [N, N, 1, 2, 3, 4, 5, 6, 7, 7, 7]
    assert col(clean.fill_linear(series([N, N]), ["x"])) == [N, N]
    assert col(clean.fill_backward(series(GAPPY), ["x"])) == [1, 1, 1, 7, 7, 7, 7, 7, 7, N, N]


def test_outliers_are_interpolated(series):
    xs = [10.0, 11.0] * 30 + [500.0] + [10.0, 12.0]
    out = col(clean.remove_outliers(series(xs), "x"))
    assert out[60] == pytest.approx(10.5) and len(out) == 63


def test_constant_series_has_no_outliers(series):
    assert col(clean.remove_outliers(series([3, 3, 3]), "x")) == [3, 3, 3]
    assert anomalies.detect(series([3, 3, 3]), "x").count() == 0


def test_drop_sparse_is_strict(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0), (3, None, None)], "i int, a double, b double")
    assert [r["i"] for r in clean.drop_sparse_rows(df, ["a", "b"]).collect()] == [2]


def test_resample_keeps_empty_hours(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:10:00', 1D), "
                   "(TIMESTAMP_NTZ'2024-01-01 02:10:00', NULL) t(ts, x)").withColumn("y", F.col("x"))
    out = resample(df, "H", means=["x"], sums=["y"]).orderBy("slot").collect()
    assert [(r["x"], r["y"]) for r in out] == [(1, 1), (N, 0), (N, 0)]
    out = resample(df, "H", sums=["y"], empty_sum="null").orderBy("slot").collect()
    assert [r["y"] for r in out] == [1, N, N]


def test_grid_before_1970_and_months(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'1969-12-31 22:30:00'), (TIMESTAMP_NTZ'1970-01-01 01:00:00') t(ts)")
    hours = [str(r["ts"]) for r in time_grid(df, "H").orderBy("ts").collect()]
    assert hours == ["1969-12-31 22:00:00", "1969-12-31 23:00:00", "1970-01-01 00:00:00", "1970-01-01 01:00:00"]
    months = [str(r["ts"]) for r in time_grid(df, "M").orderBy("ts").collect()]
    assert months == ["1969-12-31 00:00:00", "1970-01-31 00:00:00"]


def test_season_and_peak_hours(spark):
    days = spark.sql("SELECT d::timestamp_ntz AS ts FROM (SELECT explode(sequence(DATE'2023-01-15', DATE'2023-12-15', INTERVAL 1 MONTH)) AS d)")
    assert col(features.add_calendar(days), "season", "ts") == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    hours = spark.range(24).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int"))).alias("ts"))
    flagged = features.add_calendar(hours).where("is_peak_hour = 1")
    assert col(flagged, "hour", "ts") == [7, 8, 9, 10, 18, 19, 20, 21, 22]


def test_rolling_uses_previous_rows(series):
    out = features.add_rolling(series([1, 3, 2, 5, 4, 6, 8, 7]), "x", [3])
    assert col(out, "x_roll_mean_3")[3:] == pytest.approx([2, 10 / 3, 11 / 3, 5, 6])
    assert col(out, "x_roll_std_3") == [N, N, N, *[pytest.approx(v, abs=1e-6) for v in (1, 1.527525, 1.527525, 1, 2)]]
    gap = features.add_rolling(series([1, N, 2, 5, 4, 6]), "x", [3])
    assert col(gap, "x_roll_min_3") == [N, N, N, N, N, 2]


def test_degree_hours_keep_nulls(spark):
    df = spark.createDataFrame([(20.0,), (10.0,), (None,)], "temperature_c double").withColumn(
        "ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    out = features.add_interactions(df).collect()
    assert [(r["hdd"], r["cdd"], r["temp_x_hour"]) for r in out] == [(0, 2, 100), (8, 0, 50), (N, N, N)]


def test_leak_safe_columns_hold_no_target(series):
    df = features.add_interactions(features.add_calendar(series(range(5)).withColumn("occupancy", F.lit(1.0))), "x")
    assert "peak_power" in features.feature_columns(df, "x", leak_safe=False)
    assert not {"peak_power", "occupancy_x_power", "x"} & set(features.feature_columns(df, "x"))


def test_scale_of_constant_is_zero(series):
    df = series([4, 4])
    assert col(features.scale(df, "x", features.value_range(df, "x")), "scaled") == [0, 0]


def test_split_sizes(series):
    out = splits.split_temporal(series(range(11)))
    assert [r["split"] for r in out.orderBy("slot").collect()] == ["train"] * 8 + ["test"] * 3
    small = splits.split_temporal(series(range(5)), val_ratio=0.1)
    assert "validation" not in {r["split"] for r in small.collect()}


def test_cv_folds(series):
    folds = splits.cv_folds(series(range(13)))
    test = {(r["fold"], r["slot"]) for r in folds.where("role = 'test'").collect()}
    assert test == {(f, s) for f in range(5) for s in (3 + 2 * f, 4 + 2 * f)}
    assert folds.where("fold = 2 AND role = 'train'").count() == 7


def test_centred_mean_and_even_period(series):
    df = series(range(10)).withColumn("ord", F.col("slot"))
    assert col(diagnostics.centred_mean(df, "x", 7), "ma") == [N, N, N, 3, 4, 5, 6, N, N, N]
    assert col(diagnostics.centred_mean(df, "x", 4), "ma") == [N, N, 2, 3, 4, 5, 6, 7, N, N]


def test_acf_and_lag_correlation(series):
    df = series([1, 3, 2, 5, 4, 6, 8, 7])
    assert col(diagnostics.acf(df, "x", 3, None), "acf", "lag") == pytest.approx([1, .494048, .285714, -.10119], abs=1e-6)
    out = diagnostics.lag_autocorrelation(df, "x", (1, 2))
    assert col(out, "autocorr", "lag") == pytest.approx([.704203, .841282], abs=1e-6)


def test_decompose(series):
    xs = [10, 12, 9, 11, 14, 20, 18, 11, 13, 10, 12, 15, 21, 19, 12, 14, 11, 13, 16, 22, 20]
    out = diagnostics.seasonal_decompose(series(xs), "x").orderBy("ts").collect()
    assert [r["trend"] for r in out[3:6]] == pytest.approx([13.4286, 13.5714, 13.7143], abs=1e-4)
    assert [r["seasonal"] for r in out[:7]] == pytest.approx(
        [-3, -1.1429, -4.2857, -2.4286, .4286, 6.2857, 4.1429], abs=1e-4)
    assert [r["resid"] for r in out[3:6]] == pytest.approx([0, 0, 0], abs=1e-9)


def test_kde_matches_direct_sum(series):
    xs = [float((i * 37) % 101) / 7 for i in range(300)]
    curve = diagnostics.kde(series(xs), "x", points=50).orderBy("point").collect()
    mean = sum(xs) / len(xs)
    h = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) * len(xs) ** -0.2
    for r in curve:
        exact = sum(math.exp(-.5 * ((r["x"] - x) / h) ** 2) for x in xs) / (len(xs) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-10, abs=1e-15)


def test_histogram_counts_everything(series):
    out = diagnostics.histogram(series([0, 1, 2, 3, 4, 4, N]), "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == [1, 1, 1, 3] and out[3]["right_edge"] == 4
    assert sum(r["n"] for r in diagnostics.histogram(series([5, 5]), "x").collect()) == 2


def test_heatmap_has_all_cells(series):
    out = diagnostics.load_heatmap(series([1.0, 2.0]), "x").orderBy("hour").collect()
    assert len(out) == 24 and out[1]["Thu"] == 2 and out[2]["Mon"] is None


def test_zscore_and_severity(spark, series):
    found = anomalies.detect(series([10] * 30 + [11] * 30 + [100]), "x").collect()
    assert len(found) == 1 and found[0]["z_score"] == pytest.approx(7.674910)
    zs = [3.01, 4.0, 4.01, 5.0, 5.01, 6.0, 6.01, -6.2]
    df = spark.createDataFrame(list(enumerate(zs)), "slot int, z double")
    graded = df.withColumn("s", anomalies.severity(F.col("z")))
    assert col(graded, "s") == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]
    both = df.withColumns({"a": anomalies.direction(F.col("z")), "b": anomalies.direction(F.col("z"), F.lit(2.0), 2.0)})
    assert both.select("a", "b").distinct().count() == 2


def test_blend(series):
    out = forecast.blend(series(range(1, 169)), "x", "xgboost", 168)
    p = col(out, "p", "step")
    assert [p[i] for i in (0, 1, 24, 167)] == [73, 74, 85, 168]
    short = forecast.blend(series([2, 4, 6]), "x", "lstm", 4)
    assert col(short, "p", "step") == pytest.approx([2, 4, 6, 2])


def test_blend_noise_is_repeatable(series):
    df = series(range(1, 169))
    a, b = (col(forecast.blend(df, "x", noise=0.03, seed=5), "p", "step") for _ in range(2))
    assert a == b and a != col(forecast.blend(df, "x"), "p", "step")


def scored(spark, ys, ps):
    return spark.createDataFrame([("m", float(y), float(p)) for y, p in zip(ys, ps)], "model string, y double, p double")


def test_metrics(spark):
    r = evaluate.evaluate(scored(spark, [1, 2, 4, 0], [1.5, 2, 3, .5])).first()
    assert (r["MAE"], r["RMSE"], r["SMAPE"], r["R2"], r["Adj_R2"]) == (.5, .6124, 67.14, .8286, .7429)
    assert r["MAPE"] == pytest.approx(1250000018.75)
    s = evaluate.residual_stats(scored(spark, [1, 2, 4, 0], [1.5, 2, 3, .5])).first()
    assert (s["residual_mean"], s["residual_std"], s["residual_min"], s["residual_max"]) == (0, .612372, -.5, 1)
    perfect = evaluate.evaluate(scored(spark, [1, 2], [1, 2])).first()
    assert (perfect["MAE"], perfect["R2"]) == (0, 1)
    flat = evaluate.evaluate(scored(spark, [2, 2], [1, 3])).first()
    assert flat["R2"] == 0


def test_failed_model_is_listed_last(spark):
    board = evaluate.leaderboard(evaluate.with_failures(
        evaluate.evaluate(scored(spark, [1, 2], [1, 3])), ["m", "gone"])).collect()
    assert [(r["model"], r["rank"], r["status"]) for r in board] == [("m", 1, "ok"), ("gone", 2, "failed")]


def test_validation_reports(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 1D AS Voltage UNION ALL "
                   "SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00', NULL")
    rules = {r["rule"]: r["n"] for r in quality.validate(df, ["Voltage"], expected=["Voltage"]).collect()}
    assert rules == {"duplicate_timestamps": 1, "missing_share": 1}
    assert quality.validate(df.limit(1), ["Voltage"], expected=["Voltage"]).count() == 0


def test_describe_approximately(series):
    df = series(range(101))
    exact, rough = quality.describe(df, ["x"]).first(), quality.describe(df, ["x"], accuracy=1000).first()
    assert exact == rough and (exact["p25"], exact["p50"], exact["count"]) == (25, 50, 101)


def test_rows_without_key_are_a_series(spark, series):
    df = series([1, N, 3, 5]).withColumn("k", F.lit(None).cast("string")).unionByName(series([7, N, N, 9], keys={"k": "b"}))
    filled = clean.fill_linear(df, ["x"], keys=["k"], size=2)
    got = sorted((r["k"] or "", r["slot"], r["x"]) for r in filled.collect())
    assert [v for _, _, v in got] == pytest.approx([1, 2, 3, 5, 7, 7 + 2 / 3, 7 + 4 / 3, 9])
    hours = resample(df, "H", keys=["k"], means=["x"])
    assert hours.count() == 8 and anomalies.zscores(hours, "x", keys=["k"]).count() == 5
    ends = splits.split_temporal(hours, 0.5, keys=["k"]).groupBy("k", "split").count().collect()
    assert {r["count"] for r in ends} == {2} and len(ends) == 4


def test_rows_without_prediction_count_nowhere(spark):
    from gridtide.operators import evaluate
    full = [("a", float(y), float(y) + (0.5 if y % 2 else -0.5)) for y in range(5)]
    holes = full + [("a", 100.0, None), ("a", None, 3.0)]
    results = [evaluate.evaluate(spark.createDataFrame(rows, "model string, y double, p double")).first() for rows in (full, holes)]
    assert results[0] == results[1]


def test_no_spread_has_no_density_and_no_correlation(spark, series):
    from gridtide.operators import diagnostics
    flat = series([3.0] * 30)
    assert diagnostics.kde(flat, "x").count() == 0 and diagnostics.kde(flat.withColumn("k", F.lit(1)), "x", keys=["k"]).count() == 0
    assert {r["acf"] for r in diagnostics.acf(flat, "x", 5).collect()} == {None}


def test_density_far_from_the_crowd(series):
    from gridtide.operators import diagnostics
    import numpy as np
    xs = [i % 10 for i in range(500)] + [1000]
    rows = diagnostics.kde(series(xs), "x").orderBy("point").collect()
    h = np.std(xs, ddof=1) * len(xs) ** -0.2
    for row in rows[::50]:
        direct = np.exp(-0.5 * ((row["x"] - np.array(xs, float)) / h) ** 2).sum() / (len(xs) * h * np.sqrt(2 * np.pi))
        assert row["density"] == pytest.approx(direct, rel=2e-3, abs=1e-300)


def test_models_refuse_several_series(series):
    from gridtide.operators import seasonal, sequence, stationarity
    two = series([1.0, 2.0, 3.0]).unionByName(series([1.0, 2.0, 3.0]))
    with pytest.raises(ValueError):
        stationarity.adf(two, "x", 1)
    for model in (seasonal.SeasonalForecaster("x"), sequence.SequenceForecaster("x", 1)):
        with pytest.raises(ValueError):
            model.fit(two)
