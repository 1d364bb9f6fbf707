"""Chunked plans equal unchunked ones for any chunk size, and avoid single-task stages."""

import random

import pytest
from pyspark.sql import functions as F

from gridtide.operators import clean, diagnostics, features, quality, splits
from gridtide.plans import chunks


def values(n=500, seed=7, gap=0.25):
    rnd = random.Random(seed)
    out = [round(rnd.uniform(0, 50), 3) if rnd.random() > gap else None for _ in range(n)]
    for i in range(120, 260):
        out[i] = None
    return out


def column(df, name="x", order="slot"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("size", [7, 64, 1000])
@pytest.mark.parametrize("fill", [clean.fill_missing, clean.fill_linear, clean.fill_backward, clean.fill_forward])
def test_fills_do_not_depend_on_chunks(series, fill, size):
    df = series(values(), start=-100)
    want = column(fill(df, ["x"], size=100_000))
    got = column(fill(df, ["x"], size=size))
    assert len(got) == 500 and got == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("size", [5, 48, 1000])
def test_history_does_not_depend_on_chunks(series, size):
    df = series(values(gap=0.02), start=13)
    one = features.add_history(df, "x", lags=(1, 48), windows=(3, 24), size=100_000).orderBy("slot").collect()
    many = features.add_history(df, "x", lags=(1, 48), windows=(3, 24), size=size).orderBy("slot").collect()
    assert one == many


@pytest.mark.parametrize("size", [4, 97])
def test_ordinals(series, size):
    df = series(values()).where("x IS NOT NULL")
    rows = chunks.with_ordinal(df, (), size=size).orderBy("slot").collect()
    assert [r["ord"] for r in rows] == list(range(len(rows))) and {r["rows"] for r in rows} == {len(rows)}


@pytest.mark.parametrize("most", [1 << 16, 50, 3])
def test_row_ordinals_with_hot_series_and_hot_time(spark, most):
    rows = [("hot" if i % 3 else f"s{i % 30}", i // 400, i) for i in range(3000)] + [("hot", None, -1), (None, None, -2), (None, 5, -3)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    out = chunks.with_row_ordinal(df, ["k"], ["t", "id"], most=most).collect()
    by_key = {}
    for r in sorted(out, key=lambda r: (r["k"] or "", r["t"], r["id"])):
        by_key.setdefault(r["k"], []).append(r)
    assert len(out) == 3001  # rows without a time have no place
    for group in by_key.values():
        assert [r["ord"] for r in group] == list(range(len(group)))
        assert {r["rows"] for r in group} == {len(group)}


def test_a_crowded_minute_is_cut_into_even_parts(spark):
    """Rows of one moment are dealt by the rest of their order; rows that nothing tells apart stay together and end."""
    df = spark.range(40_000).selectExpr("timestamp_ntz'2024-01-01 00:00:30' AS ts", "pmod(xxhash64(id), 1000003) AS tie", "'a' AS k").withColumn(
        "_chunk", F.lit(7).cast("long")).withColumn("_series", F.struct(F.lit(0).alias("_"), "k"))
    hot = df.groupBy("_series", "_chunk").agg(F.count("*").alias("_n"))
    sizes = [r["count"] for r in chunks._cut(df, hot, ["ts", "tie"], 2000).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 40_000 and 15 <= len(sizes) <= 25 and max(sizes) < 6000
    same = spark.range(500).selectExpr("0 AS t", "1 AS tie")
    assert sorted(r["ord"] for r in chunks.with_row_ordinal(same, (), ["t", "tie"], most=20).collect()) == list(range(500))


def test_readings_without_a_time_change_nothing(spark):
    from gridtide.operators.clean import clean_raw, untimed
    rows = [(f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", None if i < 3 else 1.0, i) for i in range(240)]
    fine = spark.createDataFrame(rows, "t string, x double, id int").selectExpr("cast(t AS timestamp_ntz) AS ts", "x", "id")
    extra = fine.unionByName(spark.createDataFrame([(100.0, -i) for i in range(1, 6)], "x double, id int"), allowMissingColumns=True)
    assert untimed(extra).first()["untimed"] == 5 and untimed(fine).first()["untimed"] == 0
    for size in (1 << 16, 17):
        clean = [clean_raw(t, ["x"], value="x", tie=["id"], size=size).orderBy("ts").collect() for t in (fine, extra)]
        assert clean[0] == clean[1] and [r["x"] for r in clean[0]] == [1.0] * 4


def test_acf_does_not_depend_on_chunks(series):
    df = series([float(i % 13) + i * 0.01 for i in range(300)])
    one = column(diagnostics.acf(df, "x", 20, None), "acf", "lag")
    many = column(diagnostics.acf(df, "x", 20, None, size=16), "acf", "lag")
    assert many == pytest.approx(one)


def test_exact_quantiles_match_sorted_values(spark):
    rnd = random.Random(3)
    data = [(g, float(rnd.choice([0, 0, 0, 5, rnd.randint(0, 90)]))) for g in ("a", "a", "a", "b") for _ in range(250)]
    out = quality.exact_quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x").collect()
    import numpy as np
    for r in out:
        xs = [x for g, x in data if g == r["g"]]
        assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(list(np.quantile(xs, [.25, .5, .75])))


@pytest.mark.parametrize("small", [4096, 10])
def test_selected_quantiles_of_many_rows(spark, small, monkeypatch):
    """Groups beyond the sketch's accuracy, with ties, a narrow bracket, single rows and nulls; no sort of all values."""
    import numpy as np
    monkeypatch.setattr(quality, "SMALL", small)
    df = spark.range(60_000).selectExpr("CASE WHEN id < 50000 THEN 'a' WHEN id < 59000 THEN null ELSE 'b' END AS g",
                                        "CASE WHEN id % 7 = 0 THEN 3.0 WHEN id % 11 = 0 THEN null ELSE pmod(xxhash64(id), 100003) / 1e3 END AS x")
    df = df.unionByName(spark.createDataFrame([("one", 4.0), ("same", 2.0), ("same", 2.0)], "g string, x double"))
    for p in (quality.QUARTILES, (0.0, 0.001, 0.999, 1.0)):
        got = {r["g"]: [r[f"q{i}"] for i in range(len(p))] for r in quality.exact_quantiles(df, ["g"], "x", p).collect()}
        xs = {}
        for r in df.where("x IS NOT NULL").collect():
            xs.setdefault(r["g"], []).append(r["x"])
        assert got == {g: pytest.approx(np.quantile(v, p).tolist(), abs=1e-9) for g, v in xs.items()}
    plan = quality.exact_quantiles(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_tail_and_stride_per_series(series):
    df = series(range(10), keys={"k": "a"}).unionByName(series(range(3), keys={"k": "b"}))
    tail = splits.tail(df, 4, keys=["k"]).collect()
    assert sorted((r["k"], r["x"]) for r in tail) == [("a", 6), ("a", 7), ("a", 8), ("a", 9), ("b", 0), ("b", 1), ("b", 2)]
    thin = splits.stride(df, 3, keys=["k"]).collect()
    assert sorted((r["k"], r["x"]) for r in thin) == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 0)]


def test_windows_are_chunked(series):
    plan = features.add_lags(series(range(50)), "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_chunk" in plan


def test_fill_shuffles_rows_once(spark):
    """With broadcasts off, the exchange that joins the carried values also serves the windows."""
    from gridtide.operators.clean import fill_missing
    rows = spark.range(20_000).selectExpr("id % 3 AS k", "id AS slot", "CASE WHEN id % 5 > 0 THEN CAST(id AS DOUBLE) END AS x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fill_missing(rows, ["x"], keys=["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    main = [line for line in plan.splitlines() if "Exchange hashpartitioning(_series" in line and "_chunk" in line]
    assert len(main) == 2, plan  # the rows, and the edges behind the carried values


@pytest.mark.parametrize("size", [5, 30, 48, 1000])
def test_fill_and_history_in_one_pass(spark, size):
    rnd = random.Random(3)
    holes = {*range(0, 9), *range(100, 190), *range(300, 304), *range(490, 500)}
    rows = [(k, i - 40, i if i % 7 else None, None if i in holes or rnd.random() < 0.2 or k == "none" else rnd.uniform(0, 9))
            for k in ("a", None, "none") for i in range(500)]
    df = spark.createDataFrame(rows + [("a", None, 1, 5.0)], "k string, slot long, y long, x double")
    rest = dict(lags=(1, 48), windows=(3,), keys=["k"], size=size)
    filled = clean.fill_missing(df, ["x", "y"], keys=["k"], size=100_000)
    want = features.add_history(filled, "x", **{**rest, "size": 100_000}).orderBy("k", "slot").collect()
    got = features.add_filled_history(df, "x", fill=["x", "y"], **rest).orderBy("k", "slot").collect()
    assert len(got) == len(want) and got[0].asDict().keys() == want[0].asDict().keys()
    for a, b in zip(got, want):
        assert tuple(a) == pytest.approx(tuple(b), nan_ok=True)


def test_fill_and_history_shuffle_rows_once(spark):
    rows = spark.range(20_000).selectExpr("id % 3 AS k", "id AS slot", "CASE WHEN id % 5 > 0 THEN CAST(id AS DOUBLE) END AS x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.add_filled_history(rows, "x", fill=["x"], lags=(1, 24), windows=(3,), keys=["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    main = [line for line in plan.splitlines() if "Exchange hashpartitioning(_series" in line and "_chunk" in line]
    home = [line for line in plan.splitlines() if "Exchange hashpartitioning(_series" in line and "_home" in line]
    assert 2 <= len(main) <= 3 and len(home) <= 2, plan  # the rows, the edges by chunk, and maybe the carried table
