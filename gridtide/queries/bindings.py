"""The test tables as meter data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.operators.resample import resample, resample_hourly
from gridtide.schemas import SUB_METERS, TARGET

MEASURES = (TARGET, *SUB_METERS, "temperature_c", "occupancy")
SUB_METER_EVENTS = dict(zip(SUB_METERS, ("click", "view", "purchase")))
BY_TYPE = ("series_id",)


def events(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/events.parquet")
    return table.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _with_k(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))


def meter_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Single readings; every event type is one kind of load."""
    subs = [F.when(F.col("event_type") == kind, F.col("value")).alias(c)
            for c, kind in SUB_METER_EVENTS.items()]
    return _with_k(events(spark, sf)).select(
        "event_id", "ts", F.col("value").alias(TARGET), *subs,
        (F.col("_k") / 2.0 - 10).cast("double").alias("temperature_c"),
        (F.col("event_id") % 11 / F.lit(10.0)).cast("double").alias("occupancy"))


def gappy_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with the power missing where k < 10."""
    rows = _with_k(events(spark, sf))
    return rows.select("event_id", "ts", F.when(F.col("_k") >= 10, F.col("value")).alias(TARGET),
                       F.col("_k").cast("double").alias("temperature_c"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return resample_hourly(meter_raw(spark, sf), MEASURES)


def hourly_power(spark: SparkSession, sf: str) -> DataFrame:
    return resample_hourly(meter_raw(spark, sf).select("ts", TARGET), [TARGET])


def hourly_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select(F.col("event_type").alias("series_id"), "ts",
                                    F.col("value").alias(TARGET))
    return resample_hourly(rows, [TARGET], keys=BY_TYPE)


def daily_quantity(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_quantity").alias(TARGET))
    return resample(rows, "D", means=[TARGET])


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias(TARGET))
    return resample(rows, "D", sums=[TARGET], empty_sum="null")


# Gaps by hour ordinal: both edges and 59, 60, 61 and 120 hours inside.
GAPS = ((0, 2), (100, 158), (200, 259), (300, 360), (400, 519), (717, 719))


def gappy_hourly(spark: SparkSession, sf: str) -> DataFrame:
    table = hourly_power(spark, sf)
    first = table.agg(F.min("slot").alias("s")).scalar()
    at = F.col("slot") - first
    hole = F.lit(False)
    for lo, hi in GAPS:
        hole = hole | at.between(lo, hi)
    return table.withColumn(TARGET, F.when(~hole, F.col(TARGET)))
