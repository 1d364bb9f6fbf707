"""Meter files and processed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.schemas import RAW_MEASURES, RAW_TEXT


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A ``;``-separated meter file: day-first date and time, ``?`` for missing, seven measures.

    Columns are found by the names in the header, in any order; a missing one is an error, as is a
    second file with another header. Text that is not a number, and NaN, become null. Rows keep file
    order nowhere; order is explicit wherever it matters.
    """
    text = spark.read.option("sep", ";").option("header", True).option("enforceSchema", False).csv(path)
    absent = [c for c in RAW_TEXT.names if c not in text.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}")
    date, clock = F.split("Date", "/"), F.split("Time", ":")
    parts = [F.get(date, F.lit(i)) for i in (2, 1, 0)] + [F.get(clock, F.lit(i)) for i in (0, 1)]
    second = F.get(clock, F.lit(2)).try_cast("decimal(16,6)")
    ts = F.try_make_timestamp_ntz(*[x.try_cast("int") for x in parts], second)

    def number(name: str):
        x = F.col(name).try_cast("double")
        return F.when(~F.isnan(x), x).alias(name)

    return text.select(ts.alias("ts"), *[number(c) for c in RAW_MEASURES])


def write_raw(df: DataFrame, path: str) -> None:
    """Write ``ts`` and the seven measures as a meter file; missing measures become ``?``."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) if c in df.columns
            else F.lit("?").alias(c) for c in RAW_MEASURES]
    date = F.format_string("%d/%d/%04d", F.day("ts"), F.month("ts"), F.year("ts"))
    clock = F.format_string("%02d:%02d:%02d", F.hour("ts"), F.minute("ts"), F.second("ts"))
    df.select(date.alias("Date"), clock.alias("Time"), *cols).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *, time: str = "ts", fmt: str = "parquet") -> None:
    """Write a processed or feature table, partitioned by date.

    Rows meet by date before the write, so each task opens few files; a large date is split
    over several tasks by the adaptive planner.
    """
    dated = df.withColumn("date", F.to_date(time))
    writer = dated.hint("rebalance", "date").write.mode("overwrite").partitionBy("date")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def load_processed(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """Time, slot, series keys and the asked measures of a processed table.

    Fails when the table or a measure is absent. Columns that are no numbers with a fraction, such as
    series keys and the date, always stay.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no processed table at {path}") from e
    absent = [c for c in measures if c not in table.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}")
    return table.select(*[c for c, kind in table.dtypes if c in measures or kind not in ("double", "float")])


def first_available(spark: SparkSession, paths: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The first of several processed tables that exists."""
    for path in paths:
        try:
            return load_processed(spark, path, measures)
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"none of these tables exists: {list(paths)}")
