"""Anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import anomalies as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET
from gridtide.sources.reports import anomaly_export as export

GRADE = """CASE WHEN abs(round(z, 2)) > 6 THEN 'Critical' WHEN abs(round(z, 2)) > 5 THEN 'High'
  WHEN abs(round(z, 2)) > 4 THEN 'Medium' ELSE 'Low' END"""
RAW_Z = """z AS (SELECT event_id, ts, value, (value - (SELECT avg(value) FROM events))
  / (SELECT stddev_samp(value) FROM events) AS z FROM events)"""
HOUR_Z = q.HOURS + """,
z AS (SELECT ts, p, i, n, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS z FROM hours)"""


@query("anomaly_zscore", q.sql(HOUR_Z, select=(
    f"SELECT ts, round(p, 6) AS value, {q.r('z', 4, 'z_score')} FROM z WHERE abs(z) > 3")))
def anomaly_zscore(spark, sf):
    found = op.detect(b.hourly_power(spark, sf), TARGET)
    return found.select("ts", F.round(TARGET, 6).alias("value"), r("z_score", 4))


@query("anomaly_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, round(p, 6) AS value, {q.r('z', 4, 'z_score')} FROM (SELECT *, (p - avg(p) OVER s) "
    "/ stddev_samp(p) OVER s AS z FROM typed WINDOW s AS (PARTITION BY series_id)) WHERE abs(z) > 3")))
def anomaly_by_series(spark, sf):
    found = op.detect(b.hourly_by_type(spark, sf), TARGET, keys=b.BY_TYPE)
    return found.select("series_id", "ts", F.round(TARGET, 6).alias("value"), r("z_score", 4))


@query("anomaly_last_days", q.sql(HOUR_Z, select=(
    f"SELECT ts, round(p, 6) AS value, {q.r('z', 4, 'z_score')} FROM z "
    "WHERE abs(z) > 2 AND ts >= (SELECT max(ts) FROM z) - INTERVAL 10 DAY")))
def anomaly_last_days(spark, sf):
    found = op.detect_last_days(b.hourly_power(spark, sf), TARGET, 10, threshold=2.0)
    return found.select("ts", F.round(TARGET, 6).alias("value"), r("z_score", 4))


@query("anomaly_severity", q.sql(RAW_Z, select=(
    f"SELECT event_id, {q.r('value', 4, 'value')}, round(z, 2) AS z_score, {GRADE} AS severity FROM z WHERE abs(z) > 3")))
def anomaly_severity(spark, sf):
    found = op.detect(b.events(spark, sf), "value")
    return found.select("event_id", r("value", 4), F.round("z_score", 2).alias("z_score"), op.severity(F.col("z_score")).alias("severity"))


@query("anomaly_type", q.sql(RAW_Z, select=(
    "SELECT event_id, CASE WHEN z > 0 THEN 'Spike' ELSE 'Drop' END AS by_sign, "
    "CASE WHEN round(value, 4) > 2 THEN 'Spike' ELSE 'Drop' END AS by_level FROM z WHERE abs(z) > 0.9")))
def anomaly_type(spark, sf):
    found = op.detect(b.events(spark, sf), "value", threshold=0.9)
    z, v = F.col("z_score"), F.round("value", 4)
    return found.select("event_id", op.direction(z).alias("by_sign"), op.direction(z, v, 2.0).alias("by_level"))


LOG = ("SELECT row_number() OVER (ORDER BY ts) AS event_no, ts, round(p, 4) AS value, round(z, 2) AS z_score, "
       f"{GRADE} AS severity, CASE WHEN z > 0 THEN 'Spike' ELSE 'Drop' END AS type FROM z WHERE abs(z) > 3")


@query("anomaly_log", q.sql(HOUR_Z, select=LOG))
def anomaly_log(spark, sf):
    return op.event_log(b.hourly_power(spark, sf), TARGET)


@query("anomaly_log_by_series", q.sql(q.BY_TYPE, select=(
    "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS event_no, ts, round(p, 4) AS value, "
    f"round(z, 2) AS z_score, {GRADE} AS severity, CASE WHEN round(p, 4) > 2 THEN 'Spike' ELSE 'Drop' END AS type FROM "
    "(SELECT *, (p - avg(p) OVER s) / stddev_samp(p) OVER s AS z FROM typed WINDOW s AS (PARTITION BY series_id)) "
    "WHERE abs(z) > 3")))
def anomaly_log_by_series(spark, sf):
    return op.event_log(b.hourly_by_type(spark, sf), TARGET, spike_above=2.0, keys=b.BY_TYPE)


@query("anomaly_rate", q.sql(RAW_Z, select=(
    "SELECT 'rows' AS base, count(CASE WHEN abs(z) > 3 THEN 1 END) AS anomalies, count(*) AS base_rows, "
    "round(100.0::DOUBLE * count(CASE WHEN abs(z) > 3 THEN 1 END) / count(*), 2) AS rate_pct FROM z UNION ALL "
    "SELECT 'sampled', count(CASE WHEN abs(z) > 3 THEN 1 END), CAST(ceil(count(*) / 12) AS BIGINT), "
    "round(100.0::DOUBLE * count(CASE WHEN abs(z) > 3 THEN 1 END) / ceil(count(*) / 12), 2) FROM z")))
def anomaly_rate(spark, sf):
    rows = b.events(spark, sf)
    true = op.rate(rows, "value").select(F.lit("rows").alias("base"), "*")
    shown = op.rate(rows, "value", sampled_step=12).select(F.lit("sampled").alias("base"), "*")
    return true.unionByName(shown)


@query("anomaly_overlay", q.sql(
    HOUR_Z, "cut AS (SELECT max(ts) - INTERVAL 10 DAY AS c FROM z)",
    "recent AS (SELECT ts, p, z FROM z, cut WHERE ts >= c)", select=(
        "SELECT 'series' AS kind, ts, round(p, 4) AS value, NULL::DOUBLE AS z_score FROM recent UNION ALL "
        "SELECT 'anomaly', ts, round(p, 4), round(z, 2) FROM recent WHERE abs(z) > 2")))
def anomaly_overlay(spark, sf):
    return op.overlay(b.hourly_power(spark, sf), TARGET, 10, threshold=2.0)


@query("anomaly_overlay_thinned", q.sql(HOUR_Z, "seq AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS j FROM z)", select=(
    "SELECT 'series' AS kind, ts, round(p, 4) AS value, NULL::DOUBLE AS z_score FROM seq WHERE j % 12 = 0 UNION ALL "
    "SELECT 'anomaly', ts, round(p, 4), round(z, 2) FROM seq WHERE abs(z) > 2")))
def anomaly_overlay_thinned(spark, sf):
    """The dashboard's display of the whole history: every 12th row and all anomalies."""
    return op.overlay(b.hourly_power(spark, sf), TARGET, threshold=2.0, step=12)


@query("anomaly_export", q.sql(HOUR_Z, select=(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS \"Timestamp\", round(p, 4) AS \"Power_kW\", round(z, 2) AS \"Z_Score\" "
    "FROM z WHERE abs(z) > 3")))
def anomaly_export(spark, sf):
    return export(op.event_log(b.hourly_power(spark, sf), TARGET))
