"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import features as op
from gridtide.operators.clean import coerce_numeric
from gridtide.plans.chunks import with_ordinal
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET

CAL = {"hour": "hour(ts)", "dayofweek": "isodow(ts) - 1", "day": "day(ts)", "month": "month(ts)",
       "quarter": "quarter(ts)", "year": "year(ts)", "dayofyear": "dayofyear(ts)",
       "is_weekend": "(isodow(ts) >= 6)::INT", "is_weekday": "(isodow(ts) < 6)::INT",
       "season": "CASE WHEN month(ts) <= 3 THEN 0 WHEN month(ts) <= 6 THEN 1 WHEN month(ts) <= 9 THEN 2 ELSE 3 END",
       "is_peak_hour": "(hour(ts) BETWEEN 7 AND 10 OR hour(ts) BETWEEN 18 AND 22)::INT"}
CYC = {f"{n}_{f}": f"{f}(2 * pi() * {part} / {period})" for n, part, period in
       (("hour", "hour(ts)", 24), ("month", "month(ts)", 12), ("dow", "(isodow(ts) - 1)", 7)) for f in ("sin", "cos")}


def cal(*names: str) -> str:
    return ", ".join(f"CAST({CAL[n]} AS INTEGER) AS {n}" for n in names)


@query("feat_calendar", f"SELECT event_id, {cal('hour', 'dayofweek', 'day', 'month', 'quarter', 'year', 'dayofyear')} "
       "FROM events")
def feat_calendar(spark, sf):
    return op.add_calendar(b.events(spark, sf)).select(
        "event_id", "hour", "dayofweek", "day", "month", "quarter", "year", "dayofyear")


@query("feat_weekend", f"SELECT event_id, {cal('is_weekend', 'is_weekday')} FROM events")
def feat_weekend(spark, sf):
    return op.add_calendar(b.events(spark, sf)).select("event_id", "is_weekend", "is_weekday")


@query("feat_season", f"SELECT o_orderkey, {cal('season').replace('(ts)', '(o_orderdate)')} FROM orders")
def feat_season(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return op.add_calendar(orders, "o_orderdate").select("o_orderkey", "season")


@query("feat_peak_hour", f"SELECT event_id, {cal('is_peak_hour')} FROM events")
def feat_peak_hour(spark, sf):
    return op.add_calendar(b.events(spark, sf)).select("event_id", "is_peak_hour")


@query("feat_cyclical", "SELECT o_orderkey, " + ", ".join(
    q.r(e.replace("(ts)", "(o_orderdate)"), 6, n) for n, e in CYC.items()) + " FROM orders")
def feat_cyclical(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return op.add_cyclical(orders, "o_orderdate").select("o_orderkey", *[r(c) for c in CYC])


LAGS = {f"{TARGET}_lag_{k}": f"lag(p, {k}) OVER w" for k in op.LAGS}
ROLL = {f"{TARGET}_roll_{n}_{w}": f"CASE WHEN count(p) OVER f{w} = {w} THEN {f}(p) OVER f{w} END"
        for w in op.WINDOWS for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}


def windows(part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f" WINDOW w AS ({by}ORDER BY ts)" + "".join(
        f", f{n} AS ({by}ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in op.WINDOWS)


def rounded(cols: dict[str, str]) -> str:
    return ", ".join(q.r(e, 6, n) for n, e in cols.items())


@query("feat_lags", q.sql(q.HOURLY, select=f"SELECT ts, {rounded(LAGS)} FROM hourly" + windows()))
def feat_lags(spark, sf):
    return op.add_lags(b.hourly_power(spark, sf)).select("ts", *[r(c) for c in LAGS])


@query("feat_lags_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, {rounded(LAGS)} FROM typed" + windows("series_id"))))
def feat_lags_by_series(spark, sf):
    return op.add_lags(b.hourly_by_type(spark, sf), keys=b.BY_TYPE).select("series_id", "ts", *[r(c) for c in LAGS])


@query("feat_rolling", q.sql(q.HOURLY, select=f"SELECT ts, {rounded(ROLL)} FROM hourly" + windows()))
def feat_rolling(spark, sf):
    return op.add_rolling(b.hourly_power(spark, sf)).select("ts", *[r(c) for c in ROLL])


@query("feat_rolling_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, {rounded(ROLL)} FROM typed" + windows("series_id"))))
def feat_rolling_by_series(spark, sf):
    return op.add_rolling(b.hourly_by_type(spark, sf), keys=b.BY_TYPE).select("series_id", "ts", *[r(c) for c in ROLL])


DEGREE = {"temp_x_hour": "temp * hour(ts)", "hdd": "CASE WHEN temp < 18 THEN 18 - temp WHEN temp >= 18 THEN 0 END",
          "cdd": "CASE WHEN temp > 18 THEN temp - 18 WHEN temp <= 18 THEN 0 END"}
LOAD = {"occupancy_x_power": "occ * p", "peak_power": f"({CAL['is_peak_hour']}) * p"}


@query("feat_degree_hours", q.sql(q.RAW, select=f"SELECT event_id, {rounded(DEGREE)} FROM raw"))
def feat_degree_hours(spark, sf):
    return op.add_interactions(b.meter_raw(spark, sf)).select("event_id", *[r(c) for c in DEGREE])


@query("feat_interactions", q.sql(q.RAW, select=f"SELECT event_id, {rounded(LOAD)} FROM raw"))
def feat_interactions(spark, sf):
    table = op.add_interactions(op.add_calendar(b.meter_raw(spark, sf)))
    return table.select("event_id", *[r(c) for c in LOAD])


ALL_FLOAT = {**{q.NAMES[c]: c for c in q.COLS}, **LAGS, **ROLL, **CYC, **DEGREE, **LOAD}
FEATURES = q.sql(
    q.HOURLY, q.fill("hourly", "filled", q.COLS, limit=60), "wide AS (SELECT ts, " + ", ".join(f"{e} AS {n}" for n, e in ALL_FLOAT.items())
    + f", {cal(*CAL)} FROM filled" + windows() + ")",
    "feats AS (SELECT * FROM wide WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in ALL_FLOAT) + ")",
    select="")


def filled_features(spark, sf):
    """Features of the cleaned hourly table."""
    return op.feature_table(coerce_numeric(b.hourly(spark, sf), b.MEASURES), fill=b.MEASURES)


@query("feature_table", FEATURES + "SELECT ts, " + ", ".join(q.r(n, 6, n) for n in ALL_FLOAT) + ", "
       + ", ".join(CAL) + " FROM feats")
def feature_table(spark, sf):
    return filled_features(spark, sf).select("ts", *[r(c) for c in ALL_FLOAT], *CAL)


GROUPS = ([(c, "other", c in ("temperature_c", "occupancy")) for c in list(q.NAMES.values())[1:]]
          + [(c, "lag", True) for c in LAGS] + [(c, "rolling", True) for c in ROLL]
          + [(c, "calendar" if c in ("hour", "dayofweek", "month") else "other", True)
             for c in ("hour", "dayofweek", "day", "month", "quarter", "year", "dayofyear")]
          + [(c, "other" if c == "is_weekday" else "calendar", True)
             for c in ("is_weekend", "is_weekday", "season", "is_peak_hour")]
          + [(c, "cyclical", True) for c in CYC] + [(c, "other", True) for c in DEGREE]
          + [(c, "other", False) for c in LOAD])


@query("feature_catalog", FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, '{g}' AS feature_group, {str(safe).lower()} AS leak_safe, "
    f"count({c}) AS known_rows FROM feats" for i, (c, g, safe) in enumerate(GROUPS)))
def feature_catalog(spark, sf):
    return op.feature_catalog(filled_features(spark, sf))


@query("feat_sequences", q.sql(q.HOURS, select=(
    f"SELECT h.ts, {q.r('h.p', 6, 'y')}, CAST(g.i - h.i + 24 AS INTEGER) AS place, {q.r('g.p', 6, 'x')} "
    "FROM hours h JOIN hours g ON g.i BETWEEN h.i - 24 AND h.i - 1 WHERE h.i >= 24")))
def feat_sequences(spark, sf):
    """Sequences unfolded to one row per place."""
    rows = with_ordinal(b.hourly_power(spark, sf).where(F.col(TARGET).isNotNull()), ())
    seqs = op.sequences(rows, TARGET, pos="ord")
    return seqs.select("ts", r("y"), F.posexplode("x").alias("place", "x")).select("ts", "y", "place", r("x"))


@query("scale_minmax", q.sql(q.HOURLY, select=(
    "SELECT ts, " + q.r("(p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ())", 6, "scaled") + ", "
    + q.r("p", 6, "restored") + " FROM hourly")))
def scale_minmax(spark, sf):
    table = b.hourly_power(spark, sf)
    ranges = op.value_range(table, TARGET)
    both = op.unscale(op.scale(table, TARGET, ranges), "scaled", ranges, into="restored")
    return both.select("ts", r("scaled"), r("restored"))


@query("scale_minmax_by_series", q.sql(q.BY_TYPE, select=(
    "SELECT series_id, ts, " + q.r("(p - min(p) OVER s) / (max(p) OVER s - min(p) OVER s)", 6, "scaled")
    + " FROM typed WINDOW s AS (PARTITION BY series_id)")))
def scale_minmax_by_series(spark, sf):
    table = b.hourly_by_type(spark, sf)
    ranges = op.value_range(table, TARGET, keys=b.BY_TYPE)
    return op.scale(table, TARGET, ranges, keys=b.BY_TYPE).select("series_id", "ts", r("scaled"))
