"""Checks and summaries of meter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.plans.chunks import attach, join_on
from gridtide.plans.slots import epoch_seconds
from gridtide.schemas import RAW_MEASURES

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000                        # of the sketch: its ranks are off by one in so many rows at most
SMALL = 4096                             # groups of so few rows are ranked whole
BRACKET = 2 / ACCURACY + 1 / SMALL       # half the share of rows inside a bracket
SLICES = 1024                            # of a bracket, ranked apart


def null_share(c: str) -> Column:
    return F.avg(F.col(c).isNull().cast("double"))


def mean_null_share(cols: Sequence[str]) -> Column:
    return sum((null_share(c) for c in cols[1:]), null_share(cols[0])) / len(cols)


def missing_columns(df: DataFrame, expected: Sequence[str] = RAW_MEASURES) -> DataFrame:
    """One issue row per expected column the table lacks, with the number of rows without it."""
    absent = F.array(*[F.lit(c) for c in expected if c not in df.columns]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("missing_column").alias("rule"), F.explode(absent).alias("detail"), "n")


def duplicate_timestamps(df: DataFrame, *, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Rows beyond the first per series and timestamp."""
    per_ts = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"))
    return per_ts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def missing_rule(df: DataFrame, cols: Sequence[str], limit: float = 0.05, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean null share over columns and whether it exceeds ``limit``."""
    shares = df.groupBy(*keys).agg(mean_null_share(cols).alias("missing_share"))
    return shares.select(*keys, "missing_share", (F.col("missing_share") > limit).alias("exceeded"))


def missing_table(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Null count and percentage per column, in one pass."""
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = one.unpivot([*keys, "_rows"], list(cols), "column", "missing")
    pct = F.round(100.0 * F.col("missing") / F.nullif(F.col("_rows"), F.lit(0)), 2)
    return long.select(*keys, "column", "missing", pct.alias("missing_pct"))


def validate(df: DataFrame, cols: Sequence[str], *, expected: Sequence[str] = RAW_MEASURES,
             keys: Sequence[str] = (), time: str = "ts", limit: float = 0.05) -> DataFrame:
    """Issue rows (rule, detail, n) of all checks; none means the table is fine."""
    dup = duplicate_timestamps(df, keys=keys, time=time).agg(F.sum("duplicates").alias("n"))
    dup = dup.where("n > 0").select(
        F.lit("duplicate_timestamps").alias("rule"), F.lit(time).alias("detail"), F.col("n"))
    sparse = df.agg(
        mean_null_share(cols).alias("share"),
        sum((F.count(F.when(F.col(c).isNull(), 1)) for c in cols), F.lit(0)).alias("n"))
    sparse = sparse.where(F.col("share") > limit).select(
        F.lit("missing_share").alias("rule"), F.lit(f"> {limit}").alias("detail"),
        F.col("n").cast("long"))
    return missing_columns(df, expected).unionByName(dup).unionByName(sparse)


def summary(df: DataFrame, value: str, *, hours_per_row: float, cols: Sequence[str] = (),
            keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Records, extent, power statistics, missing share and energy, in one pass."""
    aggs = [
        F.count(F.lit(1)).alias("total_records"),
        F.min(time).cast("date").alias("date_from"),
        F.max(time).cast("date").alias("date_to"),
        F.round(F.avg(value), 4).alias("avg_power_kw"),
        F.round(F.max(value), 4).alias("max_power_kw"),
        F.round(F.min(value), 4).alias("min_power_kw"),
        F.round(F.stddev_samp(value), 4).alias("std_power_kw"),
        F.round(F.coalesce(F.sum(F.col(value) * hours_per_row), F.lit(0.0)), 2).alias("total_kwh"),
    ]
    if cols:
        aggs.append(F.round(100 * mean_null_share(cols), 2).alias("missing_pct"))
    return df.groupBy(*keys).agg(*aggs)


def series_stats(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation per series."""
    return df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))


def kpis(df: DataFrame, value: str, *, threshold: float = 3.0, keys: Sequence[str] = (),
         time: str = "ts") -> DataFrame:
    """Front-page numbers: extent, power, energy in MWh and the anomaly count."""
    scored = attach(df, series_stats(df, value, keys=keys), keys)
    z = F.try_divide(F.abs(F.col(value) - F.col("_mean")), F.col("_std"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(time).cast("date").alias("date_from"),
        F.max(time).cast("date").alias("date_to"),
        F.round(F.avg(value), 3).alias("avg_power"),
        F.round(F.max(value), 3).alias("max_power"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)) / 1000, 1).alias("total_mwh"),
        F.count(F.when(z > threshold, 1)).alias("anomaly_count"),
    )


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` per group, exact at any size, by selection.

    A sketch brackets each wanted rank between two values; one pass counts the rows below and inside the brackets, another
    ranks the few values inside (about one in a thousand), in slices of the bracket. Nothing is sorted as a whole or written.
    A bracket that misses its rank, which the counts would show, becomes the whole range of its group.
    """
    known = long.where(F.col(value).isNotNull()).select(*keys, value)
    ends = [max(0.0, p - BRACKET) for p in probs] + [min(1.0, p + BRACKET) for p in probs]
    m = len(probs)
    sketch = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
                                      F.percentile_approx(value, ends, ACCURACY).alias("_q"))
    rough = sketch.select(*keys, "_n", "_min", "_max", *[F.when(F.col("_n") > SMALL, F.col("_q")[i]).otherwise(F.col("_min")).alias(f"_lo{i}") for i in range(m)],
                          *[F.when(F.col("_n") > SMALL, F.col("_q")[m + i]).otherwise(F.col("_max")).alias(f"_hi{i}") for i in range(m)])
    x = F.col(value)
    counts = join_on(known, rough, keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("_n", "_min", "_max", *[f"_{e}{i}" for e in ("lo", "hi") for i in range(m)])],
        *[F.count_if(x < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(m)], *[F.count_if(x <= F.col(f"_hi{i}")).alias(f"_upto{i}") for i in range(m)])
    asked = []
    for i, p in enumerate(probs):
        rank = F.lit(p) * (F.col("_n") - 1)
        sure = (F.col(f"_below{i}") <= F.floor(rank)) & (F.col(f"_upto{i}") > F.ceil(rank))
        asked.append(F.struct(F.lit(i).alias("i"), F.floor(rank).alias("first"), F.ceil(rank).alias("second"), (rank - F.floor(rank)).alias("share"),
                              F.when(sure, F.col(f"_lo{i}")).otherwise(F.col("_min")).alias("lo"), F.when(sure, F.col(f"_hi{i}")).otherwise(F.col("_max")).alias("hi"),
                              F.when(sure, F.col(f"_below{i}")).otherwise(F.lit(0)).alias("below")))
    brackets = counts.select(*keys, F.array(*asked).alias("_asked"))
    inside = join_on(known, brackets, keys).select(*keys, value, F.explode(F.filter("_asked", lambda a: (x >= a["lo"]) & (x <= a["hi"]))).alias("_a"))
    held = inside.groupBy(*keys, "_a", value).agg(F.count(F.lit(1)).alias("_m"))
    width = F.nullif(F.col("_a.hi") - F.col("_a.lo"), F.lit(0.0))
    slice_ = F.least(F.lit(SLICES - 1), F.coalesce(F.floor((x - F.col("_a.lo")) / width * SLICES), F.lit(0)))
    held = held.withColumn("_slice", slice_)
    group = Window.partitionBy(*keys, "_a").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy(*keys, "_a", "_slice").agg(F.sum("_m").alias("_s")).select(
        *keys, "_a", "_slice", (F.coalesce(F.sum("_s").over(group), F.lit(0)) + F.col("_a.below")).alias("_base"))
    inner = Window.partitionBy(*keys, "_a", "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_on(held, bases, keys, ["_a", "_slice"]).withColumn("_upto", F.col("_base") + F.sum("_m").over(inner))

    def at(i: int, rank: str) -> Column:
        hit = (F.col("_a.i") == i) & (F.col(f"_a.{rank}") >= F.col("_upto") - F.col("_m")) & (F.col(f"_a.{rank}") < F.col("_upto"))
        return F.max(F.when(hit, x))

    picks, out = [], []
    for i in range(m):
        picks += [at(i, "first").alias(f"_first{i}"), at(i, "second").alias(f"_second{i}"), F.max(F.when(F.col("_a.i") == i, F.col("_a.share"))).alias(f"_w{i}")]
        lo, hi = F.col(f"_first{i}"), F.col(f"_second{i}")
        out.append((lo + (hi - lo) * F.col(f"_w{i}")).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


def describe(df: DataFrame, cols: Sequence[str], *, accuracy: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column.

    Quartiles are exact, by three passes; with ``accuracy`` they come from one pass with a
    relative rank error of ``1 / accuracy``.
    """
    by = [*keys, "column"]
    long = df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in cols], "column", "x")
    basic = long.groupBy(*by).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    if accuracy is None:
        quart = exact_quantiles(long, by, "x")
    else:
        q = F.percentile_approx("x", list(QUARTILES), accuracy)
        quart = long.groupBy(*by).agg(q.alias("q")).select(
            *by, *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(QUARTILES))])
    named = quart.withColumnsRenamed({c: f"_q_{c}" for c in by})
    joined = basic.join(named, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], "left")
    rounded = {"mean": "mean", "std": "std", "min": "min", "q0": "p25", "q1": "p50",
               "q2": "p75", "max": "max"}
    return joined.select(*by, "count",
                         *[F.round(F.col(c), 4).alias(a) for c, a in rounded.items()])


def extent(df: DataFrame, *, keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """First and last reading and the whole days between them."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    span = F.col("last_ts") - F.col("first_ts")
    return ends.select(*keys, "first_ts", "last_ts",
                       F.extract(F.lit("DAY"), span).cast("long").alias("days"))
