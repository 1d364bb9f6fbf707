"""Profile and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import diagnostics as op
from gridtide.queries import bindings as b
from gridtide.queries import feature as fq
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET

CUT = """cut AS (SELECT ts, p, row_number() OVER (ORDER BY ts) - 1 AS i FROM days WHERE o >= n - 365)"""


@query("consumption_overview", q.sql(q.DAILY, CUT, select=(
    f"SELECT ts, round(p, 4) AS value, round(CASE WHEN count(p) OVER w = 7 THEN avg(p) OVER w END, 4) AS ma7 "
    "FROM cut WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")))
def consumption_overview(spark, sf):
    return op.consumption_overview(b.daily_quantity(spark, sf), TARGET)


@query("consumption_overview_by_series", q.sql(
    q.BY_TYPE, "d AS (SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, avg(p) AS p FROM typed GROUP BY 1, 2)",
    "c AS (SELECT * FROM d WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 14)",
    select=(f"SELECT series_id, ts, round(p, 4) AS value, "
            f"round(CASE WHEN count(p) OVER w = 7 THEN avg(p) OVER w END, 4) AS ma7 FROM c "
            "WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")))
def consumption_overview_by_series(spark, sf):
    from gridtide.operators.resample import daily_mean
    daily = daily_mean(b.hourly_by_type(spark, sf), TARGET, keys=b.BY_TYPE)
    return op.consumption_overview(daily, TARGET, 14, keys=b.BY_TYPE)


@query("load_heatmap", q.sql(q.HOURLY, select=(
    "SELECT CAST(a.hour AS INTEGER) AS hour, " + ", ".join(
        q.r(f"avg(CASE WHEN isodow(ts) = {i + 1} THEN p END)", 4, d) for i, d in enumerate(op.WEEKDAYS))
    + " FROM (SELECT unnest(range(24)) AS hour) a LEFT JOIN hourly h ON hour(h.ts) = a.hour GROUP BY 1")))
def load_heatmap(spark, sf):
    return op.load_heatmap(b.hourly_power(spark, sf), TARGET, digits=None).select(
        "hour", *[r(d, 4) for d in op.WEEKDAYS])


@query("load_heatmap_by_series", q.sql(q.BY_TYPE, select=(
    "SELECT a.series_id, CAST(a.hour AS INTEGER) AS hour, " + ", ".join(
        q.r(f"avg(CASE WHEN isodow(ts) = {i + 1} THEN p END)", 4, d) for i, d in enumerate(op.WEEKDAYS))
    + " FROM (SELECT series_id, unnest(range(24)) AS hour FROM (SELECT DISTINCT series_id FROM typed)) a "
    "LEFT JOIN typed h ON hour(h.ts) = a.hour AND a.series_id = h.series_id GROUP BY 1, 2")))
def load_heatmap_by_series(spark, sf):
    return op.load_heatmap(b.hourly_by_type(spark, sf), TARGET, digits=None, keys=b.BY_TYPE).select(
        "series_id", "hour", *[r(d, 4) for d in op.WEEKDAYS])


@query("power_histogram", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
h AS (SELECT least(floor((value - lo) * 80 / (hi - lo)), 79) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT CAST(a.bin AS BIGINT) AS bin, round(lo + a.bin * ((hi - lo) / 80), 6) AS left_edge,
       round(lo + (a.bin + 1) * ((hi - lo) / 80), 6) AS right_edge, coalesce(n, 0) AS n
FROM (SELECT unnest(range(80)) AS bin) a CROSS JOIN e LEFT JOIN h ON h.bin = a.bin""")
def power_histogram(spark, sf):
    return op.histogram(b.events(spark, sf), "value").select("bin", r("left_edge"), r("right_edge"), "n")


@query("power_kde", q.sql(
    q.HOURS, "s AS (SELECT min(p) AS lo, max(p) AS hi, count(p) AS n, stddev_samp(p) * pow(count(p), -0.2) AS h FROM hours)",
    "axis AS (SELECT i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 999) AS x, s.n AS n, h FROM (SELECT unnest(range(1000)) AS i), s)",
    select=(f"SELECT CAST(axis.i AS BIGINT) AS point, {q.r('x', 6, 'x')}, "
            + q.r("sum(exp(-0.5 * pow((x - p) / h, 2))) / (any_value(axis.n) * any_value(h) * sqrt(2 * pi()))", 8, "density")
            + " FROM axis, hours WHERE p IS NOT NULL GROUP BY axis.i, x")))
def power_kde(spark, sf):
    return op.kde(b.hourly_power(spark, sf), TARGET).select("point", r("x"), r("density", 8))


@query("seasonal_decompose", q.sql(
    q.DAILY, "cut AS (SELECT ts, p, o AS i FROM days)",
    "t AS (SELECT ts, p, i, CASE WHEN count(p) OVER w = 7 THEN avg(p) OVER w END AS trend FROM cut "
    "WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))",
    "ph AS (SELECT i % 7 AS f, avg(p - trend) AS s FROM t GROUP BY 1)",
    select=("SELECT ts, " + q.r("p", 6, "observed") + ", " + q.r("trend", 6, "trend") + ", "
            + q.r("s - (SELECT avg(s) FROM ph)", 6, "seasonal") + ", "
            + q.r("p - trend - (s - (SELECT avg(s) FROM ph))", 6, "resid") + " FROM t JOIN ph ON i % 7 = f")))
def seasonal_decompose(spark, sf):
    parts = op.seasonal_decompose(b.daily_quantity(spark, sf), TARGET)
    return parts.select("ts", *[r(c) for c in ("observed", "trend", "seasonal", "resid")])


ACF = ("tail AS (SELECT ts, p, o AS i FROM days)",
       "c AS (SELECT i, p - avg(p) OVER () AS x FROM tail)",
       "acf AS (SELECT k AS lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM c) AS acf "
       "FROM (SELECT unnest(range(49)) AS k) JOIN c a ON true JOIN c b ON b.i = a.i + k GROUP BY 1)")


@query("acf", q.sql(q.DAILY, *ACF, select=f"SELECT CAST(lag AS INTEGER) AS lag, {q.r('acf', 6, 'acf')} FROM acf"))
def acf(spark, sf):
    return op.acf(b.daily_quantity(spark, sf), TARGET).select("lag", r("acf"))


@query("acf_by_series", q.sql(
    q.BY_TYPE, "c AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, "
    "p - avg(p) OVER (PARTITION BY series_id) AS x FROM typed WHERE p IS NOT NULL)",
    "v AS (SELECT series_id, sum(x * x) AS v FROM c GROUP BY 1)",
    select=(f"SELECT a.series_id, CAST(k AS INTEGER) AS lag, {q.r('sum(a.x * b.x) / any_value(v)', 6, 'acf')} "
            "FROM (SELECT unnest(range(25)) AS k) JOIN c a ON true JOIN c b ON b.i = a.i + k AND a.series_id = b.series_id "
            "JOIN v ON v.series_id = a.series_id GROUP BY 1, 2")))
def acf_by_series(spark, sf):
    return op.acf(b.hourly_by_type(spark, sf), TARGET, 24, None, keys=b.BY_TYPE).select("series_id", "lag", r("acf"))


@query("pacf", q.sql(
    q.DAILY, *ACF, "r AS (SELECT list(acf ORDER BY lag) AS r FROM acf)",
    "step(k, phi, v) AS (SELECT 1, [r[2]], r[2] FROM r UNION ALL "
    "SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - v2 * phi[k + 1 - j]), v2), v2 FROM "
    "(SELECT k, phi, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) "
    "/ (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS v2 FROM step, r WHERE k < 48))",
    select=f"SELECT 0 AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT CAST(k AS INTEGER), {q.r('v')} FROM step"))
def pacf(spark, sf):
    return op.pacf(b.daily_quantity(spark, sf), TARGET).select("lag", r("pacf"))


CORRELATED = ("Sub_metering_1", "Sub_metering_2", "Sub_metering_3", "temperature_c", "occupancy", "hour", "dayofweek",
              "day", "is_weekend", "is_weekday", "is_peak_hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
              f"{TARGET}_lag_1", f"{TARGET}_lag_2", f"{TARGET}_lag_3", f"{TARGET}_lag_6", f"{TARGET}_lag_12")


@query("feature_correlation", fq.FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {q.r(f'corr({c}, {TARGET})', 6, 'corr')} FROM feats" for c in CORRELATED))
def feature_correlation(spark, sf):
    table = fq.filled_features(spark, sf)
    return op.correlation(table, TARGET, CORRELATED).select("feature", r("corr"))


@query("lag_autocorr", q.sql(
    q.HOURLY, "lagged AS (SELECT p, " + ", ".join(f"lag(p, {k}) OVER (ORDER BY o) AS l{k}" for k in op.TABLE_LAGS)
    + " FROM hourly)", select=" UNION ALL ".join(
        f"SELECT {k} AS lag, {q.r(f'corr(p, l{k})', 6, 'autocorr')} FROM lagged" for k in op.TABLE_LAGS)))
def lag_autocorr(spark, sf):
    return op.lag_autocorrelation(b.hourly_power(spark, sf), TARGET).select("lag", r("autocorr"))


@query("correlation_by_series", q.sql(q.BY_TYPE, select=" UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, {q.r(f'corr({x}, p)', 6, 'corr')} FROM typed GROUP BY 1"
    for c, x in (("hour", "hour(ts)"), ("day", "day(ts)")))))
def correlation_by_series(spark, sf):
    table = b.hourly_by_type(spark, sf).withColumns({"hour": F.hour("ts"), "day": F.day("ts")})
    return op.correlation(table, TARGET, ["hour", "day"], keys=b.BY_TYPE).select("series_id", "feature", r("corr"))
