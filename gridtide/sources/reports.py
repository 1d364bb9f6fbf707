"""Small result files: metrics and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.schemas import METRICS


def save_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines, one per model."""
    metrics.select(*METRICS.names).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved metrics; no rows when none were saved."""
    try:
        return spark.read.schema(METRICS).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRICS)


def _minute_text(ts: str) -> Column:
    return F.substring(F.col(ts).cast("timestamp_ntz").cast("string"), 1, 16)


def anomaly_export(log: DataFrame) -> DataFrame:
    """Anomaly log in export columns."""
    return log.select(_minute_text("ts").alias("Timestamp"),
                      F.col("value").alias("Power_kW"), F.col("z_score").alias("Z_Score"))


def forecast_export(forecast: DataFrame) -> DataFrame:
    """Forecast in export columns."""
    return forecast.select(_minute_text("ts").alias("Timestamp"),
                           F.round("p", 4).alias("Forecast_kW"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
