"""Column names and schemas of the meter data model."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "Global_active_power"
SUB_METERS = ("Sub_metering_1", "Sub_metering_2", "Sub_metering_3")

# The seven measures of a raw meter file, in file order.
RAW_MEASURES = (
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
)

RAW_TEXT = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("Date", "Time", *RAW_MEASURES)]
)

METRICS = T.StructType(
    [T.StructField("model", T.StringType())]
    + [T.StructField(name, T.DoubleType())
       for name in ("MAE", "RMSE", "MAPE", "SMAPE", "R2", "Adj_R2")]
)
