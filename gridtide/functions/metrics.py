"""Forecast metrics as aggregate expressions over (actual, predicted) columns.

Only rows with both values count, in every metric.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8  # fixed value: smallest denominator of the percentage errors


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    return 100 * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY)))


def smape(y: Column, p: Column) -> Column:
    half = (F.abs(y) + F.abs(p)) / 2
    return 100 * F.avg(F.abs(y - p) / F.greatest(half, F.lit(TINY)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; a constant actual scores 1 when hit exactly and 0 otherwise."""
    y = F.when(p.isNotNull(), y)
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst == 0, flat).otherwise(1 - F.try_divide(sse, sst))


def adj_r2(y: Column, p: Column, k: Column) -> Column:
    """Adjusted for ``k`` features; plain R2 when there are too few rows."""
    n = F.count(F.when(p.isNotNull(), y))
    score = r2(y, p)
    return F.when(n <= k + 1, score).otherwise(
        1 - (1 - score) * F.try_divide(n - 1, n - k - 1))
