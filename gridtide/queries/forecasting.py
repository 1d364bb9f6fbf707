"""Forecasts without a fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import forecast as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET
from gridtide.sources.reports import forecast_export as export


def blend_sql(weight: float, steps: int = 48) -> str:
    return (f"fc AS (SELECT s AS step, (SELECT max(ts) FROM hours) + (s + 1) * INTERVAL 1 HOUR AS ts, "
            f"greatest(0, {weight}::DOUBLE * w.p + (1 - {weight}::DOUBLE) * d.p) AS p "
            f"FROM (SELECT unnest(range({steps})) AS s) "
            "JOIN hours w ON w.i = w.n - least(w.n, 168) + s % least(w.n, 168) "
            "JOIN hours d ON d.i = d.n - least(d.n, 24) + s % least(d.n, 24))")


@query("forecast_blend", " UNION ALL ".join(
    f"SELECT '{m}' AS model, * FROM ("
    + q.sql(q.HOURS, blend_sql(w, 200), select=f"SELECT CAST(step AS INTEGER) AS step, ts, {q.r('p', 6, 'p')} FROM fc") + ")"
    for m, w in op.WEEK_WEIGHT.items()))
def forecast_blend(spark, sf):
    table, out = b.hourly_power(spark, sf), None
    for model in op.WEEK_WEIGHT:
        part = op.blend(table, TARGET, model, 200).select(F.lit(model).alias("model"), "step", "ts", r("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query("forecast_blend_by_series", q.sql(
    q.BY_TYPE, "h AS (SELECT series_id, ts, p, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, "
    "count(*) OVER (PARTITION BY series_id) AS n, max(ts) OVER (PARTITION BY series_id) AS e FROM typed WHERE p IS NOT NULL)",
    select=("SELECT w.series_id, CAST(s AS INTEGER) AS step, w.e + (s + 1) * INTERVAL 1 HOUR AS ts, "
            f"{q.r('greatest(0, 0.5 * w.p + 0.5 * d.p)', 6, 'p')} FROM (SELECT unnest(range(48)) AS s) "
            "JOIN h w ON w.i = w.n - least(w.n, 168) + s % least(w.n, 168) "
            "JOIN h d ON d.i = d.n - least(d.n, 24) + s % least(d.n, 24) AND d.series_id = w.series_id")))
def forecast_blend_by_series(spark, sf):
    table = op.blend(b.hourly_by_type(spark, sf), TARGET, keys=b.BY_TYPE)
    return table.select("series_id", "step", "ts", r("p"))


@query("forecast_with_context", q.sql(q.HOURS, blend_sql(0.5), select=(
    "SELECT 'actual' AS kind, ts, round(p, 4) AS value FROM hours WHERE i >= n - 48 UNION ALL "
    "SELECT 'forecast', ts, round(p, 4) FROM fc")))
def forecast_with_context(spark, sf):
    table = b.hourly_power(spark, sf)
    return op.with_context(table, TARGET, op.blend(table, TARGET))


@query("forecast_summary", q.sql(q.HOURS, blend_sql(0.5), select=(
    "SELECT round(min(p), 3) AS min_kw, round(avg(p), 3) AS mean_kw, round(max(p), 3) AS max_kw FROM fc")))
def forecast_summary(spark, sf):
    return op.summarise(op.blend(b.hourly_power(spark, sf), TARGET))


@query("forecast_band", q.sql(q.HOURS, blend_sql(0.5), "d AS (SELECT stddev_samp(p) AS d FROM hours)", select=(
    f"SELECT 'std' AS kind, ts, {q.r('p - 1.96 * d', 6, 'lower')}, {q.r('p + 1.96 * d', 6, 'upper')} FROM fc, d UNION ALL "
    f"SELECT 'percent', ts, {q.r('p - p * 0.05')}, {q.r('p + p * 0.05')} FROM fc")))
def forecast_band(spark, sf):
    table = b.hourly_power(spark, sf)
    fc = op.blend(table, TARGET)
    spread = table.agg(F.stddev_samp(TARGET)).scalar()
    bands = [op.band(fc, std=s).select(F.lit(kind).alias("kind"), "ts", r("lower"), r("upper"))
             for kind, s in (("std", spread), ("percent", None))]
    return bands[0].unionByName(bands[1])


@query("forecast_ensemble", q.sql(
    q.HOURS, blend_sql(0.5), blend_sql(0.4).replace("fc AS", "fl AS", 1),
    select=f"SELECT fc.ts, {q.r('0.4 * fc.p + 0.6 * fl.p', 6, 'p')} FROM fc JOIN fl ON fc.ts = fl.ts"))
def forecast_ensemble(spark, sf):
    table = b.hourly_power(spark, sf)
    parts = {m: op.blend(table, TARGET, m) for m in ("xgboost", "lstm")}
    return op.ensemble(parts, {"xgboost": 0.4, "lstm": 0.6}).select("ts", r("p"))


@query("forecast_csv_columns", q.sql(q.HOURS, blend_sql(0.7), select=(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS \"Timestamp\", round(p, 4) AS \"Forecast_kW\" FROM fc")))
def forecast_csv_columns(spark, sf):
    return export(op.blend(b.hourly_power(spark, sf), TARGET, "arima"))
