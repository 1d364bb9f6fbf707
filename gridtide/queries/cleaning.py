"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import clean as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import SUB_METERS, TARGET

P = q.r("p", 6, TARGET)


@query("clean_drop_sparse", q.sql(q.RAW, select=(
    f"SELECT event_id, {P} FROM raw WHERE (" + " + ".join(f"({c} IS NULL)::INT" for c in q.COLS) + ") / 6.0 < 0.5")))
def clean_drop_sparse(spark, sf):
    return op.drop_sparse_rows(b.meter_raw(spark, sf), b.MEASURES).select("event_id", r(TARGET))


@query("fill_forward_limit", q.sql(q.GAPPY, select=(
    "SELECT ts, " + q.r("coalesce(p, last_value(p IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN 60 PRECEDING "
                        "AND 1 PRECEDING))", 6, TARGET) + " FROM gaps")))
def fill_forward_limit(spark, sf):
    return op.fill_forward(b.gappy_hourly(spark, sf), [TARGET], limit=60).select("ts", r(TARGET))


@query("fill_linear_both", q.sql(q.GAPPY, q.fill("gaps", "done", ["p"]), select=f"SELECT ts, {P} FROM done"))
def fill_linear_both(spark, sf):
    return op.fill_linear(b.gappy_hourly(spark, sf), [TARGET]).select("ts", r(TARGET))


@query("fill_backward", q.sql(q.GAPPY, select=(
    "SELECT ts, " + q.r("first_value(p IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW "
                        "AND UNBOUNDED FOLLOWING)", 6, TARGET) + " FROM gaps")))
def fill_backward(spark, sf):
    return op.fill_backward(b.gappy_hourly(spark, sf), [TARGET]).select("ts", r(TARGET))


@query("fill_missing", q.sql(q.GAPPY, q.fill("gaps", "done", ["p"], limit=60), select=f"SELECT ts, {P} FROM done"))
def fill_missing(spark, sf):
    return op.fill_missing(b.gappy_hourly(spark, sf), [TARGET]).select("ts", r(TARGET))


@query("fill_missing_by_series", q.sql(
    q.BY_TYPE, q.fill("typed", "done", ["p"], limit=2, part="series_id"),
    select=f"SELECT series_id, ts, {P} FROM done"))
def fill_missing_by_series(spark, sf):
    table = b.hourly_by_type(spark, sf)
    return op.fill_missing(table, [TARGET], limit=2, keys=b.BY_TYPE).select("series_id", "ts", r(TARGET))


@query("fill_missing_by_time", q.sql(
    """rows AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS o, avg(CASE WHEN k >= 10 THEN p END) AS p
  FROM (SELECT ts, value AS p, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1)""",
    """held AS (SELECT o, p, last_value(p IGNORE NULLS) OVER w AS v,
    last_value(CASE WHEN p IS NOT NULL THEN o END IGNORE NULLS) OVER w AS a,
    first_value(p IGNORE NULLS) OVER z AS u, first_value(CASE WHEN p IS NOT NULL THEN o END IGNORE NULLS) OVER z AS q
  FROM rows WINDOW w AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    z AS (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    select="SELECT o AS seconds, " + q.r(
        "CASE WHEN v IS NULL THEN u WHEN u IS NULL OR o - a <= 600 THEN v "
        "ELSE v + (u - v) * (o - a - 600) / (q - a - 600) END", 6, TARGET) + " FROM held"))
def fill_missing_by_time(spark, sf):
    """Readings per second, held for ten minutes and then drawn to the next one."""
    from gridtide.plans.slots import epoch_seconds
    rows = b.gappy_raw(spark, sf).groupBy(epoch_seconds("ts").alias("seconds")).agg(
        F.avg(TARGET).alias(TARGET))
    return op.fill_missing_by_time(rows, [TARGET], hold_seconds=600).select("seconds", r(TARGET))


@query("clean_outliers", q.sql(
    q.BY_TYPE, "stats AS (SELECT avg(p) AS m, stddev_samp(p) AS d FROM typed)",
    "masked AS (SELECT series_id, ts, o, CASE WHEN abs((p - m) / d) > 2 THEN NULL ELSE p END AS p FROM "
    "(SELECT *, avg(p) OVER (PARTITION BY series_id) AS m, stddev_samp(p) OVER (PARTITION BY series_id) AS d FROM typed))",
    q.fill("masked", "done", ["p"], edges="trailing", part="series_id"),
    select=f"SELECT series_id, ts, {P} FROM done"))
def clean_outliers(spark, sf):
    """Values beyond two standard deviations of their series, interpolated."""
    table = b.hourly_by_type(spark, sf)
    return op.remove_outliers(table, TARGET, threshold=2.0, keys=b.BY_TYPE).select("series_id", "ts", r(TARGET))


@query("clean_coerce", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS DOUBLE)
  AS reading FROM events""")
def clean_coerce(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    rows = b.events(spark, sf).select("event_id", text.alias("reading"))
    return op.coerce_numeric(rows, ["reading"])


@query("clean_dropna", q.sql(q.RAW, select=f"SELECT event_id, {P} FROM raw WHERE s1 IS NOT NULL"))
def clean_dropna(spark, sf):
    return op.drop_null_rows(b.meter_raw(spark, sf), [SUB_METERS[0]]).select("event_id", r(TARGET))


KEPT = ("kept AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS o, p, s1, s2, s3, temp, occ FROM raw "
        "WHERE (" + " + ".join(f"({c} IS NULL)::INT" for c in q.COLS) + ") / 6.0 < 0.5)")
SMOOTH = (
    "masked AS (SELECT ts, o, CASE WHEN abs((p - avg(p) OVER ()) / stddev_samp(p) OVER ()) > 5 THEN NULL ELSE p END "
    "AS p, s1, s2, s3, temp, occ FROM filled)",
    q.fill("masked", "line", ["p"], edges="trailing"),
    "smooth AS (SELECT m.ts, l.p, s1, s2, s3, temp, occ FROM masked m JOIN line l ON m.o = l.o)")


@query("clean_hourly", q.sql(
    q.RAW, KEPT, q.fill("kept", "filled", q.COLS, limit=60), *SMOOTH, q.hourly_from("smooth"),
    q.fill("hourly", "done", q.COLS, limit=60), select=f"SELECT ts, {q.named(q.COLS)} FROM done"))
def clean_hourly(spark, sf):
    return op.clean_raw(b.meter_raw(spark, sf), b.MEASURES, tie=["event_id"]).select(
        "ts", *[r(c) for c in b.MEASURES])


@query("clean_daily", q.sql(
    q.RAW, KEPT, q.fill("kept", "filled", q.COLS, limit=60), *SMOOTH,
    "daily AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, row_number() OVER (ORDER BY date_trunc('day', ts)) AS o, "
    + ", ".join(f"avg({c}) AS {c}" for c in q.COLS) + " FROM smooth GROUP BY date_trunc('day', ts))",
    q.fill("daily", "done", q.COLS, limit=60), select=f"SELECT ts, {q.named(q.COLS)} FROM done"))
def clean_daily(spark, sf):
    return op.clean_raw(b.meter_raw(spark, sf), b.MEASURES, freq="D", tie=["event_id"]).select(
        "ts", *[r(c) for c in b.MEASURES])


@query("clean_light", q.sql(q.HOURLY, q.fill("hourly", "done", q.COLS, limit=60),
                            select=f"SELECT ts, {q.named(q.COLS)} FROM done"))
def clean_light(spark, sf):
    return op.clean_regular(b.hourly(spark, sf), b.MEASURES).select("ts", *[r(c) for c in b.MEASURES])
