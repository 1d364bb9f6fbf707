"""Reader and writer queries: they write the test tables out and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import evaluate as ev
from gridtide.queries import bindings as b
from gridtide.queries import evaluation as e
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import SUB_METERS, TARGET
from gridtide.session import scratch_path
from gridtide.sources import meter, reports

POWER = q.sql(q.HOURLY, select=f"SELECT ts, {q.r('p', 6, TARGET)} FROM hourly")


@query("src_raw_meter", q.sql(q.RAW, select=(
    f"SELECT date_trunc('second', ts) AS ts, p AS {TARGET}, NULL::DOUBLE AS Voltage, s1 AS Sub_metering_1, "
    "s2 AS Sub_metering_2, s3 AS Sub_metering_3 FROM raw")))
def src_raw_meter(spark, sf):
    path = scratch_path(spark, "raw")
    meter.write_raw(b.meter_raw(spark, sf), path)
    return meter.read_raw(spark, path).select("ts", TARGET, "Voltage", *SUB_METERS)


def _write_hourly(spark, sf, name: str) -> str:
    path = scratch_path(spark, name)
    meter.write_table(b.hourly_power(spark, sf), path)
    return path


@query("src_processed", POWER)
def src_processed(spark, sf):
    return meter.load_processed(spark, _write_hourly(spark, sf, "processed"), [TARGET]).select("ts", r(TARGET))


@query("src_first_available", POWER)
def src_first_available(spark, sf):
    present = _write_hourly(spark, sf, "processed")
    paths = [scratch_path(spark, "absent"), present, scratch_path(spark, "absent")]
    return meter.first_available(spark, paths, [TARGET]).select("ts", r(TARGET))


@query("sink_roundtrip", q.sql(q.HOURLY, select=f"SELECT ts, ts::DATE AS date, {q.r('p', 6, TARGET)} FROM hourly"))
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    meter.write_table(b.hourly_power(spark, sf), path, fmt="csv")
    back = spark.read.schema(f"slot long, ts timestamp_ntz, {TARGET} double, date date").option(
        "header", True).csv(path)
    return back.select("ts", "date", r(TARGET))


@query("metrics_roundtrip", q.sql(*e.SCORED, select="SELECT * FROM scored"))
def metrics_roundtrip(spark, sf):
    path = scratch_path(spark, "metrics")
    reports.save_metrics(e.metrics(spark, sf), path)
    return reports.load_metrics(spark, path)


@query("forecast_export", q.sql(e.BACKTEST, select=(
    f"SELECT ts, {q.r('y', 6, 'actual')}, {q.r('w', 6, 'pred')} FROM done WHERE i >= n - 200")))
def forecast_export(spark, sf):
    wide, _ = e.forecast.backtest(b.hourly_power(spark, sf), TARGET)
    forecast = wide.where("naive_day IS NOT NULL").select("ts", F.col("naive_week").alias("p"))
    path = scratch_path(spark, "forecast")
    reports.write_csv(ev.actual_vs_forecast(b.hourly_power(spark, sf), forecast, value=TARGET), path)
    back = spark.read.schema("ts timestamp_ntz, actual double, pred double").option("header", True).csv(path)
    return back.select("ts", r("actual"), r("pred"))
