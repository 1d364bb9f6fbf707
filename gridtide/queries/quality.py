"""Quality and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import quality as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import RAW_MEASURES, SUB_METERS, TARGET

CHECKED = (TARGET, *SUB_METERS, "temperature_c")
GAPPY_FIVE = """five AS (
  SELECT ts, CASE WHEN k >= 10 THEN p END AS p, s1, s2, s3, temp FROM raw)"""
FIVE = ("p", "s1", "s2", "s3", "temp")
SHARE = " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)" for c in FIVE)


def five(spark, sf):
    """Readings with sub-meters and missing power."""
    raw = b.meter_raw(spark, sf)
    k = (F.col("temperature_c") + 10) * 2
    return raw.withColumn(TARGET, F.when(k >= 10, F.col(TARGET))).select("ts", *CHECKED)


ABSENT = ("SELECT 'missing_column' AS rule, c AS detail, (SELECT count(*) FROM events) AS n FROM "
          "(VALUES ('Global_reactive_power'), ('Voltage'), ('Global_intensity')) v(c)")


@query("dq_columns", ABSENT)
def dq_columns(spark, sf):
    return op.missing_columns(b.meter_raw(spark, sf), RAW_MEASURES)


@query("dq_duplicates", "SELECT CAST(count(*) - count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS duplicates "
       "FROM events")
def dq_duplicates(spark, sf):
    """Readings sharing an hour, by whole-hour timestamps."""
    hours = b.events(spark, sf).select(
        (F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))).alias("ts"))
    return op.duplicate_timestamps(hours)


@query("dq_duplicates_by_series", "SELECT event_type AS series_id, "
       "CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS duplicates FROM events GROUP BY 1")
def dq_duplicates_by_series(spark, sf):
    rows = b.events(spark, sf).select(F.col("event_type").alias("series_id"), "ts")
    return op.duplicate_timestamps(rows, keys=b.BY_TYPE)


@query("dq_missing_rule", q.sql(q.RAW, GAPPY_FIVE, select=(
    f"SELECT {q.r(f'({SHARE}) / 5', 6, 'missing_share')}, ({SHARE}) / 5 > 0.05 AS exceeded FROM five")))
def dq_missing_rule(spark, sf):
    return op.missing_rule(five(spark, sf), CHECKED).select(r("missing_share"), "exceeded")


@query("dq_missing_table", q.sql(q.RAW, GAPPY_FIVE, select=" UNION ALL ".join(
    f"SELECT '{q.NAMES[c]}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM five" for c in FIVE)))
def dq_missing_table(spark, sf):
    return op.missing_table(five(spark, sf), CHECKED)


@query("dq_report", q.sql(q.RAW, GAPPY_FIVE, select=(
    ABSENT + " UNION ALL "
    "SELECT 'duplicate_timestamps', 'ts', n FROM (SELECT count(*) - count(DISTINCT ts) AS n FROM five) WHERE n > 0 "
    f"UNION ALL SELECT 'missing_share', '> 0.05', n FROM (SELECT ({SHARE}) / 5 AS s, "
    + " + ".join(f"(count(*) - count({c}))" for c in FIVE) + " AS n FROM five) WHERE s > 0.05")))
def dq_report(spark, sf):
    return op.validate(five(spark, sf), CHECKED)


SUMMARY = """count(*) AS total_records, min(ts)::DATE AS date_from, max(ts)::DATE AS date_to,
 round(avg(p), 4) AS avg_power_kw, round(max(p), 4) AS max_power_kw, round(min(p), 4) AS min_power_kw,
 round(stddev_samp(p), 4) AS std_power_kw"""


@query("summary_minute", q.sql(q.RAW, GAPPY_FIVE, select=(
    f"SELECT {SUMMARY}, round(sum(p / 60), 2) AS total_kwh, round(100 * ({SHARE}) / 5, 2) AS missing_pct FROM five")))
def summary_minute(spark, sf):
    return op.summary(five(spark, sf), TARGET, hours_per_row=1 / 60, cols=CHECKED)


@query("summary_hourly", q.sql(q.HOURLY, select=f"SELECT {SUMMARY}, round(sum(p), 2) AS total_kwh FROM hourly"))
def summary_hourly(spark, sf):
    return op.summary(b.hourly_power(spark, sf), TARGET, hours_per_row=1)


@query("summary_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, {SUMMARY}, round(sum(p), 2) AS total_kwh FROM typed GROUP BY series_id")))
def summary_by_series(spark, sf):
    return op.summary(b.hourly_by_type(spark, sf), TARGET, hours_per_row=1, keys=b.BY_TYPE)


@query("summary_kpis", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
SELECT count(*) AS total_records, min(ts)::DATE AS date_from, max(ts)::DATE AS date_to,
       round(avg(value), 3) AS avg_power, round(max(value), 3) AS max_power,
       round(sum(value) / 1000, 1) AS total_mwh,
       count(CASE WHEN abs(value - m) / d > 3 THEN 1 END) AS anomaly_count
FROM events, s""")
def summary_kpis(spark, sf):
    return op.kpis(b.events(spark, sf), "value")


@query("describe_numeric", q.sql(q.HOURLY, select=" UNION ALL ".join(
    f"SELECT '{q.NAMES[c]}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
    + ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {a}" for p, a in
                ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + f", round(max({c}), 4) AS max FROM hourly" for c in q.COLS)))
def describe_numeric(spark, sf):
    return op.describe(b.hourly(spark, sf), b.MEASURES)


@query("series_extent", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, "
       "CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS days FROM events")
def series_extent(spark, sf):
    return op.extent(b.events(spark, sf))


@query("dq_missing_rule_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, {q.r('avg((p IS NULL)::INT)', 6, 'missing_share')}, avg((p IS NULL)::INT) > 0.05 AS exceeded FROM typed GROUP BY 1")))
def dq_missing_rule_by_series(spark, sf):
    found = op.missing_rule(b.hourly_by_type(spark, sf), [TARGET], keys=b.BY_TYPE)
    return found.select("series_id", r("missing_share"), "exceeded")


@query("dq_missing_table_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, '{TARGET}' AS \"column\", count(*) - count(p) AS missing, "
    "round(100.0::DOUBLE * (count(*) - count(p)) / count(*), 2) AS missing_pct FROM typed GROUP BY 1")))
def dq_missing_table_by_series(spark, sf):
    return op.missing_table(b.hourly_by_type(spark, sf), [TARGET], keys=b.BY_TYPE)


@query("describe_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, '{TARGET}' AS \"column\", count(p) AS count, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, "
    "round(min(p), 4) AS min, " + ", ".join(f"round(quantile_cont(p, {x}), 4) AS {a}" for x, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + ", round(max(p), 4) AS max FROM typed GROUP BY 1")))
def describe_by_series(spark, sf):
    return op.describe(b.hourly_by_type(spark, sf), [TARGET], keys=b.BY_TYPE)
