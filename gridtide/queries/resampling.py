"""Resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import resample as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET


@query("resample_hourly", q.sql(q.HOURLY, select=f"SELECT ts, {q.named(q.COLS)} FROM hourly"))
def resample_hourly(spark, sf):
    return b.hourly(spark, sf).select("ts", *[r(c) for c in b.MEASURES])


@query("resample_hourly_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, {q.r('p', 6, 'Global_active_power')} FROM typed")))
def resample_hourly_by_series(spark, sf):
    return b.hourly_by_type(spark, sf).select("series_id", "ts", r(TARGET))


@query("resample_daily", q.sql(q.HOURLY, select=(
    "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, "
    + ", ".join(q.r(f"avg({c})", 6, q.NAMES[c]) for c in q.COLS) + " FROM hourly GROUP BY 1")))
def resample_daily(spark, sf):
    return op.resample_daily(b.hourly(spark, sf), b.MEASURES).select("ts", *[r(c) for c in b.MEASURES])


@query("time_grid", """
SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS ts
FROM (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders)""")
def time_grid(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return op.time_grid(orders, "D", time="o_orderdate").select("ts")


@query("time_grid_by_series", q.sql(q.BY_TYPE, select="SELECT series_id, ts FROM typed_grid"))
def time_grid_by_series(spark, sf):
    rows = b.events(spark, sf).select(F.col("event_type").alias("series_id"), "ts")
    return op.time_grid(rows, "H", keys=b.BY_TYPE).select("series_id", "ts")


@query("daily_mean", q.sql(q.DAILY, select=(
    f"SELECT ts, {q.r('p', 6, 'Global_active_power')} FROM days")))
def daily_mean(spark, sf):
    return op.daily_mean(b.daily_quantity(spark, sf), TARGET).select("ts", r(TARGET))


@query("daily_orders", """
WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS p FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d)
SELECT g.ts, round(p, 2) AS Global_active_power FROM g LEFT JOIN d ON g.ts = d.ts""")
def daily_orders(spark, sf):
    return b.daily_orders(spark, sf).select("ts", r(TARGET, 2))


def mean_per(freq: str, bucket: str, value: str, table: str) -> str:
    return (f"SELECT '{freq}' AS freq, {bucket}::TIMESTAMP AS ts, {q.r(f'avg({value})', 4, 'mean_price')} "
            f"FROM {table} GROUP BY 2")


@query("resample_freq", " UNION ALL ".join((
    mean_per("D", "date_trunc('day', o_orderdate)", "o_totalprice", "orders"),
    mean_per("M", "last_day(o_orderdate)", "o_totalprice", "orders"),
    mean_per("T", "date_trunc('minute', ts)", "value", "events"),
    mean_per("H", "date_trunc('hour', ts)", "value", "events"))))
def resample_freq(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("mean_price"))
    readings = b.events(spark, sf).select("ts", F.col("value").alias("mean_price"))
    out = None
    for freq, table in (("D", orders), ("M", orders), ("T", readings), ("H", readings)):
        part = op.resample(table, freq, means=["mean_price"], grid=False).select(
            F.lit(freq).alias("freq"), "ts", r("mean_price", 4))
        out = part if out is None else out.unionByName(part)
    return out
