"""Fits against numpy, plain loops and known series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import boosting, evaluate, features, splits, stationarity
from gridtide.operators.seasonal import Order, SeasonalForecaster, invertible
from gridtide.operators.sequence import SequenceForecaster
from gridtide.session import materialise, scratch_path


def noise(n, seed=1):
    return np.random.default_rng(seed).normal(size=n)


@pytest.fixture(scope="module")
def several(spark):
    """Series of several kinds by key, some of them unfit, and their values."""
    t = np.arange(300)
    fine = {"a": 20 + 0.02 * t + 5 * np.sin(2 * np.pi * t / 12) + 0.5 * noise(300, 2), "b": np.cumsum(noise(260, 3)) + 100,
            None: noise(300, 4) + 10}
    rows = [(k, 100 + i, float(v)) for k, y in fine.items() for i, v in enumerate(y)]
    rows += [("gap", i, 1.0 * i * i % 7) for i in range(150) if i != 20] + [("short", i, float(i)) for i in range(5)]
    rows += [("null", i, None if i == 30 else float(i % 5)) for i in range(150)] + [("twice", i % 149, float(i % 3)) for i in range(150)]
    return materialise(spark.createDataFrame(rows, "k string, slot long, x double")), fine


UNFIT = {"gap": "positions are missing", "null": "values are missing", "short": "too few rows", "twice": "rows share a position"}


# ---------------------------------------------------------------- stationarity

def by_least_squares(y, lags, begin=None):
    rows = stationarity.design(y, lags, lags + 1 if begin is None else begin)
    x, d = rows[:, :-1], rows[:, -1]
    weights, *_ = np.linalg.lstsq(x, d, rcond=None)
    return x, weights, float(((d - x @ weights) ** 2).sum())


def adf_of(y, lags=None):
    if lags is None:
        most, found = stationarity.longest_lag(len(y)), []
        whole = stationarity.design(y, most, most + 1)
        for k in range(most + 1):
            x = whole[:, :2 + k]
            w, *_ = np.linalg.lstsq(x, whole[:, -1], rcond=None)
            found.append(len(x) * math.log(((whole[:, -1] - x @ w) ** 2).sum() / len(x)) + 2 * (k + 2))
        lags = int(np.argmin(found))
    x, weights, squares = by_least_squares(y, lags)
    return lags, weights[1] / math.sqrt(squares / (len(x) - lags - 2) * np.linalg.inv(x.T @ x)[1, 1])


@pytest.mark.parametrize("size", [4096, 64])
@pytest.mark.parametrize("lags", [None, 0, 5])
def test_adf_of_many_series(several, size, lags):
    df, fine = several
    rows = {r["k"]: r for r in stationarity.adf(df, "x", lags, keys=["k"], size=size).collect()}
    assert {k: rows[k]["status"] for k in UNFIT} == UNFIT
    for k, y in fine.items():
        want, t = adf_of(y, lags)
        assert rows[k]["lags"] == want and rows[k]["statistic"] == pytest.approx(t, rel=1e-8)
        assert rows[k]["stationary"] == (rows[k]["p_value"] < 0.05)
    assert rows[None]["stationary"] and not rows["b"]["stationary"]


def test_adf_of_one_series_and_a_constant(series):
    assert stationarity.adf(series([3.0] * 40), "x").first()["status"] == "constant"
    with pytest.raises(ValueError, match="missing"):
        stationarity.adf(series([1.0, 2.0, None] * 20), "x")


def test_p_values_at_published_points():
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert stationarity.p_value(statistic) == pytest.approx(p, abs=0.002)
    assert stationarity.p_value(-30) == 0 and stationarity.p_value(5) == 1
    assert stationarity.p_value(-1.6101) == pytest.approx(stationarity.p_value(-1.6099), abs=1e-2)


# ---------------------------------------------------------------- seasonal model

def shocks_of(order, weights, y):
    constant, ar, sar, ma, sma = order.parts(weights)
    w, whole, moving = np.convolve(y, order.differences())[order.lost:len(y)], np.convolve(ar, sar), np.convolve(ma, sma)
    e = np.zeros(len(w))
    for t in range(order.ar_reach, len(w)):
        e[t] = sum(whole[k] * w[t - k] for k in range(len(whole))) - constant - sum(moving[k] * e[t - k] for k in range(1, len(moving)) if t >= k)
    return e


def ahead_of(order, weights, y, e, steps):
    constant, ar, sar, ma, sma = order.parts(weights)
    whole, moving = np.convolve(np.convolve(ar, sar), order.differences()), np.convolve(ma, sma)
    y, e = list(y), list(e)
    for _ in range(steps):
        y.append(constant - sum(whole[k] * y[-k] for k in range(1, len(whole))) + sum(moving[k] * e[-k] for k in range(1, len(moving))))
        e.append(0.0)
    return y[-steps:]


@pytest.mark.parametrize("order", [Order(1, 1, 1, 1, 1, 1, 12), Order(2, 0, 1, 0, 1, 1, 12, True), Order(0, 1, 2, 0, 0, 0, 1), Order(0, 1, 0, 0, 1, 0, 12)])
def test_seasonal_fit_of_many_series(several, order):
    df, fine = several
    model = SeasonalForecaster("x", order, ["k"], max_steps=8, chunk=64).fit(df)
    rows = {r["k"]: r for r in model.fits.collect()}
    assert {k: rows[k]["status"] for k in UNFIT} == UNFIT
    ahead = {}
    for r in model.forecast(600).collect():
        ahead.setdefault(r["k"], {})[r["step"]] = r["p"]
    assert set(ahead) == set(fine)
    for k, y in fine.items():
        e = shocks_of(order, rows[k]["weights"], y)
        counted = e[order.ar_reach:]
        assert rows[k]["squares"] == pytest.approx(float(counted @ counted), rel=1e-7) and rows[k]["counted"] == len(counted)
        assert rows[k]["squares"] <= rows[k]["start_squares"] * (1 + 1e-12) and invertible(order, rows[k]["weights"])
        want = ahead_of(order, rows[k]["weights"], y, e, 600)
        assert [ahead[k][i] for i in range(600)] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_chunks_do_not_change_the_seasonal_fit(several):
    df, fine = several
    df = df.where("k = 'a'")
    order, told = Order(1, 1, 1, 0, 1, 1, 12), []
    for size in (4096, 40, 7):
        model = SeasonalForecaster("x", order, ["k"], max_steps=4, chunk=size).fit(df)
        fitted = model.fitted(df).orderBy("slot").collect()
        told.append((list(model.fits.first()["weights"]), [r["p"] for r in fitted]))
    for weights, p in told[1:]:
        assert weights == pytest.approx(told[0][0], abs=1e-8)
        assert [x is None for x in p] == [x is None for x in told[0][1]]
        assert [x for x in p if x is not None] == pytest.approx([x for x in told[0][1] if x is not None], abs=1e-8)


def test_the_fit_is_a_minimum(several):
    """Small changes of any weight do not lessen the sum of squares."""
    df, fine = several
    order = Order(1, 0, 1, 1, 0, 0, 12, True)
    model = SeasonalForecaster("x", order, ["k"], max_steps=20).fit(df)
    for r in model.fits.where("status = 'ok'").collect():
        for i in range(len(order.names)):
            for move in (1e-3, -1e-3):
                near = list(r["weights"])
                near[i] += move
                e = shocks_of(order, near, fine[r["k"]])[order.ar_reach:]
                assert float(e @ e) >= r["squares"] * (1 - 1e-6)


def test_seasonal_forecast_beats_naive(series, spark):
    n, ahead = 24 * 30, 24
    t = np.arange(n + ahead)
    xs = 20 + 0.02 * t + 5 * np.sin(2 * np.pi * t / 24) + 0.3 * noise(n + ahead)
    df = materialise(series(xs[:n]))
    model = SeasonalForecaster("x", max_steps=6).fit(df)
    p = np.array([r["p"] for r in model.forecast(ahead).orderBy("step").collect()])
    assert np.abs(p - xs[n:]).mean() < 0.5 * np.abs(xs[n - 1] - xs[n:]).mean()
    assert model.fitted(df).where("p IS NOT NULL").select(F.avg(F.abs(F.col("x") - F.col("p")))).first()[0] < 1
    told = {r["name"]: r["value"] for r in model.summary().collect()}
    assert told["bic"] > told["aic"] and told["aic"] == pytest.approx(2 * 5 - 2 * told["log_likelihood"])
    path = scratch_path(spark, "seasonal")
    model.save(path)
    again = SeasonalForecaster.load(spark, path)
    assert again.order == model.order and [r["p"] for r in again.forecast(ahead).orderBy("step").collect()] == p.tolist()


def test_orders_are_checked(series):
    for bad in ({"p": -1}, {"season": 1}, {"p": 24}):
        with pytest.raises(ValueError):
            Order(**bad)
    with pytest.raises(ValueError, match="too few"):
        SeasonalForecaster("x").fit(series(list(range(60))))
    with pytest.raises(RuntimeError):
        SeasonalForecaster("x").forecast(3)


# ---------------------------------------------------------------- sequence model

@pytest.mark.parametrize("size", [4096, 50])
def test_sequence_model_of_many_series(spark, size):
    t = np.arange(400)
    ys = {"a": 0.5 + 0.4 * np.sin(2 * np.pi * t / 24) + 0.02 * noise(400, 5), "b": np.random.default_rng(6).uniform(size=400)}
    ys["a"][50] = 3.0
    df = materialise(spark.createDataFrame([(k, 7 + i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "k string, slot long, x double"))
    model = SequenceForecaster("x", 12, ["k"], chunk=size).fit(df)
    weights = {r["k"]: np.array(r["weights"]) for r in model.fits.collect()}
    last = {}
    for r in model.history().orderBy("iteration").collect():
        last[r["k"]] = r
    for k, y in ys.items():
        x = np.stack([np.ones(388), *[y[12 - j:400 - j] for j in range(1, 13)]], axis=1)
        error = y[12:] - x @ weights[k]
        cut = int(388 * 0.9)
        slope = -(x[:cut] * np.clip(error[:cut], -0.1, 0.1)[:, None]).mean(axis=0) + 1e-4 * np.r_[0, weights[k][1:]]
        assert np.abs(slope).max() < 1e-5  # nothing left to gain
        loss = np.where(np.abs(error) <= 0.1, error**2 / 2, 0.1 * (np.abs(error) - 0.05))
        assert last[k]["loss"] == pytest.approx(loss[:cut].mean(), rel=1e-3) and last[k]["val_mae"] == pytest.approx(np.abs(error[cut:]).mean(), rel=1e-3)
        p = [r["p"] for r in model.predict(df.where(F.col("k") == k)).orderBy("slot").collect()]
        assert p[:12] == [None] * 12 and p[12:] == pytest.approx((x @ weights[k]).tolist())
        want = list(y)
        for _ in range(600):
            want.append(weights[k][0] + weights[k][1:] @ np.array(want[-12:])[::-1])
        ahead = [r["p"] for r in model.multi_step(df, 600).where(F.col("k") == k).orderBy("step").collect()]
        assert ahead == pytest.approx(want[400:], abs=1e-9)


def test_sequence_model_continues_a_sine(series, spark):
    xs = [0.5 + 0.4 * math.sin(2 * math.pi * i / 24) + 0.01 * e for i, e in enumerate(noise(240))]
    df = materialise(series(xs))
    model = SequenceForecaster("x", max_steps=10).fit(df)
    ahead = [r["p"] for r in model.multi_step(df, 24).orderBy("step").collect()]
    assert ahead == pytest.approx([0.5 + 0.4 * math.sin(2 * math.pi * i / 24) for i in range(240, 264)], abs=0.1)
    path = scratch_path(spark, "seq")
    model.save(path)
    again = SequenceForecaster.load(spark, path)
    assert [r["p"] for r in again.multi_step(df, 24).orderBy("step").collect()] == ahead


# ---------------------------------------------------------------- trees

@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4)).round(2)
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600)
    rows = [(i, *map(float, a), float(v), i % 7 == 0) for i, (a, v) in enumerate(zip(x, y))]
    return materialise(spark.createDataFrame(rows, "slot long, a double, b double, c double, d double, y double, held boolean")), x, y


def test_best_iteration_patience():
    assert boosting.best_iteration([5, 4, 3, 3.5, 3.4, 1], patience=2) == 3
    assert boosting.best_iteration([5, 4, 3, 3.5, 3.4, 1], patience=5) == 6


def exhaustive(cells, gradient, depth, params):
    """The tree's value of every row, by trying all splits."""
    value = boosting.leaf_value(gradient.sum(), len(gradient), params["l1"], params["l2"]) * np.ones(len(gradient))
    if depth == 0:
        return value
    best = (1e-12,)
    gains = lambda g: boosting.score(g.sum(), len(g), params["l1"], params["l2"])
    for f in range(cells.shape[1]):
        for cut in np.unique(cells[:, f]):
            left = cells[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= params["least_rows"]:
                gain = 0.5 * (gains(gradient[left]) + gains(gradient[~left]) - gains(gradient))
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if len(best) == 2:
        for side in (best[1], ~best[1]):
            value[side] = exhaustive(cells[side], gradient[side], depth - 1, params)
    return value


def test_trees_are_those_of_an_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, size=(300, 3)).astype(float)
    y = x[:, 0] * 0.5 + (x[:, 1] > 4) * x[:, 2] + rng.normal(size=300) * 0.2
    df = spark.createDataFrame([(*map(float, a), float(v)) for a, v in zip(x, y)], "a double, b double, c double, y double")
    params = {"rounds": 4, "depth": 3, "rate": 0.3, "rows_share": 1.0, "features_share": 1.0, "l1": 0.5, "l2": 2.0}
    model = boosting.TreeForecaster(["a", "b", "c"], "y", params).fit(df)
    p = np.full(300, y.mean())
    for _ in range(4):
        p += 0.3 * exhaustive(x, p - y, 3, {**boosting.TREE_PARAMS, **params})
    got = sorted((r["y"], r["p"]) for r in model.predict(df).collect())
    assert [v for _, v in got] == pytest.approx([v for _, v in sorted(zip(y, p))], abs=1e-9)


def test_growing_stops_and_keeps_the_first_trees(wavy):
    df, _, _ = wavy
    params = {"rounds": 60, "rate": 0.5, "depth": 3, "rows_share": 1.0}
    model = boosting.TreeForecaster(list("abcd"), "y", params).fit(df, "held", patience=4)
    errors = [e for _, e in model.history]
    kept = int(np.argmin(errors)) + 1
    assert len(model.trees) == kept and len(errors) in (kept + 4, 60)
    shorter = boosting.TreeForecaster(list("abcd"), "y", {**params, "rounds": 5}).fit(df.where("not held"))
    assert [t.feature for t in shorter.trees] == [t.feature for t in model.trees[:5]] or len(model.trees) < 5
    seen = model.predict(df).where("held").select(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert seen == pytest.approx(min(errors), rel=1e-9)


def test_importance_and_saving(wavy, spark):
    df, x, _ = wavy
    model = boosting.TreeForecaster(list("abcd"), "y", {"rounds": 6, "depth": 3, "rows_share": 1.0}).fit(df)
    nodes = model.nodes(spark).collect()
    splits_ = [n for n in nodes if n["feature"] is not None]
    weight = {r["feature"]: r["importance"] for r in model.importance(spark, "weight").collect()}
    assert sum(weight.values()) == len(splits_) and set(weight) == set("abcd")
    by = {(n["tree"], n["node"]): n for n in nodes}
    for n in splits_:  # rows of a node are those of its children, and the root has all
        assert n["cover"] == by[n["tree"], n["left"]]["cover"] + by[n["tree"], n["right"]]["cover"]
        if n["node"] == 0:
            assert n["cover"] == 600 and by[n["tree"], n["left"]]["cover"] == df.where(F.col(n["feature"]) <= n["threshold"]).count()
    gain = model.importance(spark, "gain").collect()
    mean = {f: np.mean([n["gain"] for n in splits_ if n["feature"] == f]) for f in {n["feature"] for n in splits_}}
    assert {r["feature"]: r["importance"] for r in gain if r["importance"]} == pytest.approx(mean)
    assert sum(r["share"] for r in gain) == pytest.approx(1) and [r["importance"] for r in gain] == sorted((r["importance"] for r in gain), reverse=True)
    path = scratch_path(spark, "trees")
    model.save(spark, path)
    again = boosting.TreeForecaster.load(spark, path)
    assert (again.params, again.features, again.base) == (model.params, model.features, model.base)
    assert model.predict(df).select("p").collect() == again.predict(df).select("p").collect()
    with pytest.raises(ValueError):
        model.importance(spark, "other")


def test_packs_and_nulls(wavy, monkeypatch, spark):
    """The same trees from many packs, sums added up by feature first, and nulls as the smallest value."""
    df, _, _ = wavy
    params = {"rounds": 3, "depth": 3, "rows_share": 1.0}
    holes = materialise(df.withColumn("a", F.when(F.col("slot") % 5 > 0, F.col("a"))).repartition(7))
    one = boosting.TreeForecaster(list("abcd"), "y", params).fit(holes)
    monkeypatch.setattr(boosting, "PACK_ROWS", 64)
    monkeypatch.setattr(boosting, "DIRECT", 2)
    monkeypatch.setattr(boosting, "RENEW", 1)
    other = boosting.TreeForecaster(list("abcd"), "y", params).fit(holes)
    assert [(t.feature, t.threshold) for t in one.trees] == [(t.feature, t.threshold) for t in other.trees]
    lowest = materialise(holes.withColumn("a", F.coalesce("a", F.lit(-1e9))))
    assert one.predict(holes).agg(F.sum("p")).first()[0] == pytest.approx(one.predict(lowest).agg(F.sum("p")).first()[0])


def test_cross_validation_by_series(wavy):
    df, _, _ = wavy
    twice = df.withColumn("k", F.lit("u")).unionByName(df.withColumn("k", F.lit("v")).withColumn("y", -F.col("y")))
    model = boosting.TreeForecaster(list("abcd"), "y", {"rounds": 3, "depth": 2})
    rows = boosting.cross_validate(model, twice, 2, keys=["k"]).collect()
    assert {r["k"] for r in rows} == {"u", "v"} and all(r["cv_rmse_mean"] > 0 for r in rows)
    with pytest.raises(ValueError):
        boosting.cross_validate(model, twice)


# ---------------------------------------------------------------- comparison

def test_a_failed_model_leaves_the_others_scored(spark):
    actual = spark.createDataFrame([(i, float(i)) for i in range(10)], "ts long, x double")

    def broken():
        raise ValueError("no luck\nat all")

    makers = {"good": lambda: actual.where("ts > 1").selectExpr("ts", "x + 1 AS p"), "broken": broken,
              "late": lambda: actual.where("ts > 4").selectExpr("ts", "x AS p"), "none": lambda: actual.limit(0).selectExpr("ts", "x AS p"),
              "bad": lambda: actual.selectExpr("ts", "cast(raise_error('in a task') AS double) AS p")}
    forecasts, reasons = evaluate.attempt(makers)
    assert set(reasons) == {"broken", "bad"} and reasons["broken"] == "ValueError: no luck"
    table = evaluate.align(actual, forecasts, value="x")
    assert {(r["model"], r["count"]) for r in table.groupBy("model").count().collect()} == {("good", 5), ("late", 5)}
    rows = {r["model"]: r for r in evaluate.with_failures(evaluate.evaluate(table), list(makers), reasons).collect()}
    assert {k for k, r in rows.items() if r["status"] == "failed"} == {"broken", "none", "bad"} and rows["good"]["MAE"] == 1


def test_trees_on_lags_beat_the_mean(series):
    xs = [10 + 5 * math.sin(2 * math.pi * i / 24) for i in range(600)]
    table = materialise(features.add_lags(series(xs), "x", (1, 2, 24)).where("x_lag_24 IS NOT NULL"))
    parts = materialise(splits.split_temporal(table))
    model = boosting.TreeForecaster(["x_lag_1", "x_lag_2", "x_lag_24"], "x", {"rounds": 15, "depth": 4, "rate": 0.3})
    scored = model.fit(parts.where("split = 'train'")).predict(parts.where("split = 'test'"))
    r = evaluate.evaluate(scored.select(F.lit("trees").alias("model"), F.col("x").alias("y"), "p")).first()
    assert r["R2"] > 0.9 and r["MAE"] <= r["RMSE"]
