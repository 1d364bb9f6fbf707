"""Augmented Dickey-Fuller test of many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.plans.chunks import CHUNK
from gridtide.plans.packs import described, in_one_piece, packed, per_row, totals
from gridtide.session import materialise

# Response surfaces published by MacKinnon for the regression with a constant.
P_LOW = (2.1659, 1.4412, 0.038269)                       # statistics up to P_TURN
P_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)          # beyond it
P_TURN, P_LEAST, P_MOST = -1.61, -18.83, 2.74
CRITICAL_5PCT = (-2.86154, -2.8903, -4.234, -40.040)     # in powers of 1 / rows


def p_value(statistic: float) -> float:
    """Share of unit-root series with a smaller statistic."""
    if statistic <= P_LEAST:
        return 0.0
    if statistic >= P_MOST:
        return 1.0
    z = sum(c * statistic**i for i, c in enumerate(P_LOW if statistic <= P_TURN else P_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def critical_5pct(rows: int) -> float:
    return sum(c / rows**i for i, c in enumerate(CRITICAL_5PCT))


def longest_lag(rows: int) -> int:
    """The usual largest number of lagged differences for a series of ``rows`` values."""
    return max(0, min(math.ceil(12 * (rows / 100) ** 0.25), rows // 2 - 2))


def design(y: np.ndarray, lags: int, begin: int) -> np.ndarray:
    """Rows 1, earlier value, ``lags`` differences and the difference to explain, for places from ``begin`` on."""
    d = np.diff(y)
    n = max(0, len(y) - begin)
    columns = [np.ones(n), y[begin - 1:len(y) - 1], *[d[begin - 1 - k:begin - 1 - k + n] for k in range(1, lags + 1)], d[begin - 1:]]
    return np.stack(columns, axis=1) if n else np.zeros((0, lags + 3))


def least_squares(products: np.ndarray, inputs: Sequence[int]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Weights, sum of squares and inverse of the chosen columns on the last one; None if they are collinear."""
    a, b, c = products[np.ix_(inputs, inputs)], products[inputs, -1], float(products[-1, -1])
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a / np.outer(scale, scale)
    if np.linalg.cond(scaled) > 1e13:
        return None
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    weights = inverse @ b
    return weights, max(c - 2 * weights @ b + weights @ a @ weights, 0.0), inverse


def lag_products(df: DataFrame, value: str, lags: int, *, keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Keys, ``i``, ``j``, ``total``: sums of products of the columns constant, value, ``lags`` differences, difference.

    One pass. The sums run over the rows that have all lags; the value is the one before, less the series' mean.
    """
    packs, stats = _prepared(df, value, keys, pos, lags, size)
    rows = packs.join(stats.where("status IS NULL").select("_series", "start", "mean"), "_series")
    sums = totals(rows.withColumn("lags", F.lit(lags)), _products)
    wide = lags + 3
    return sums.select(*[F.col(f"_series.`{k}`") for k in keys], F.posexplode(F.slice("total", 1, wide * wide)).alias("at", "total")).select(
        *keys, F.floor(F.col("at") / wide).cast("int").alias("i"), (F.col("at") % wide).cast("int").alias("j"), "total")


def _prepared(df, value, keys, pos, most, size):
    packs = materialise(packed(df, value, keys, pos, most + 1, max(size, 2 * (most + 3))), "packs")
    return packs, materialise(described(packs, 8), "series")


def _products(row: dict) -> np.ndarray:
    """Products over the chunk, then the series' first values if the chunk holds them, else zeros."""
    lags = row["lags"]
    y = row["values"] - row["mean"]
    given = len(y) - row["n"]
    begin = max(given, lags + 1 if row["first"] == row["start"] else 0, 1)
    head = y[:lags + 1] if row["first"] == row["start"] else y[:0]
    x = design(y, lags, max(begin, lags + 1))
    return np.concatenate([(x.T @ x).ravel(), np.pad(head, (0, lags + 1 - len(head)))])


def _decide(row: dict, chosen: int | None) -> dict:
    most, wide = row["lags"], row["lags"] + 3
    products, head = row["total"][:wide * wide].reshape(wide, wide), row["total"][wide * wide:]
    none = {"lags": None, "statistic": None, "p_value": None, "critical_5pct": critical_5pct(row["rows"]), "stationary": None, "status": "constant"}
    n, best = products[0, 0], None
    for lags in [chosen] if chosen is not None else range(most + 1):
        found = least_squares(products, [0, 1, *range(2, 2 + lags)])
        if found is None or found[1] <= 1e-12 * products[-1, -1] or products[-1, -1] == 0:
            continue
        criterion = n * math.log(found[1] / n) + 2 * (lags + 2)
        if best is None or criterion < best[0]:
            best = criterion, lags
    if best is None:
        return none
    lags = best[1]
    early = design(head, lags, lags + 1)  # rows that have the chosen lags, but not the longest
    inputs = [0, 1, *range(2, 2 + lags), wide - 1]
    products = products[np.ix_(inputs, inputs)] + early.T @ early
    found = least_squares(products, range(lags + 2))
    if found is None or products[0, 0] <= lags + 2:
        return none
    weights, squares, inverse = found
    t = float(weights[1] / math.sqrt(squares / (products[0, 0] - lags - 2) * inverse[1, 1]))
    p = p_value(t)
    return {"lags": lags, "statistic": t, "p_value": p, "critical_5pct": critical_5pct(int(products[0, 0])), "stationary": p < 0.05, "status": "ok"}


def adf(df: DataFrame, value: str, lags: int | None = None, *, keys: Sequence[str] = (), pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """Keys, ``rows, lags, statistic, p_value, critical_5pct, stationary, status`` per series on a dense grid.

    One pass sums the products of all lags; the orders are nested in it, so the number of lags with the smallest
    information criterion (``lags`` fixes it instead) costs no further pass. The statistic is of the regression with a constant
    on all rows that have the chosen lags. A series with gaps, nulls, repeated positions or under 8 rows gets the
    reason as its status and nulls; without keys it is an error. A constant series has no statistic.
    """
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    most = longest_lag(longest) if lags is None else lags
    packs, stats = _prepared(df, value, keys, pos, most, size)
    in_one_piece(stats, keys)
    fine = stats.where("status IS NULL")
    own = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("rows") / 100, F.lit(0.25))), F.floor(F.col("rows") / 2) - 2)).cast("int")
    fine = fine.withColumn("lags", own if lags is None else F.lit(lags))
    sums = totals(packs.join(fine.select("_series", "start", "mean", "lags"), "_series"), _products)
    shape = "lags int, statistic double, p_value double, critical_5pct double, stationary boolean, status string"
    decided = per_row(sums.join(fine.select("_series", "rows", "lags"), "_series"), lambda row: _decide(row, lags), shape)
    told = stats.select("_series", "rows", F.col("status").alias("reason")).join(decided, "_series", "left")
    return told.select(*[F.col(f"_series.`{k}`") for k in keys], "rows", "lags", "statistic", "p_value", "critical_5pct", "stationary",
                       F.coalesce("reason", "status").alias("status"))
