"""Splits and cuts by time order. Input has at most one row per series and slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.plans.chunks import attach, last_rows, with_ordinal


def split_temporal(df: DataFrame, test_ratio: float = 0.2, *, val_ratio: float = 0.0,
                   keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """Label rows ``train``, ``validation`` (the end of train) and ``test`` in column ``split``."""
    n_train = F.floor(F.col("rows") * F.lit(1 - test_ratio))
    n_val = F.floor(n_train * F.lit(float(val_ratio)))
    label = (F.when(F.col("ord") >= n_train, "test")
             .when(F.col("ord") >= n_train - n_val, "validation").otherwise("train"))
    return with_ordinal(df, keys, pos).withColumn("split", label).drop("ord", "rows")


def cv_folds(df: DataFrame, folds: int = 5, *, keys: Sequence[str] = (),
             pos: str = "slot") -> DataFrame:
    """Expanding-window folds: one row per row, fold and ``role`` (train or test)."""
    size = F.floor(F.col("rows") / (folds + 1))
    placed = with_ordinal(df, keys, pos).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("rows") - (folds - F.col("fold")) * size
    role = F.when(F.col("ord") < start, "train").when(F.col("ord") < start + size, "test")
    return placed.withColumn("role", role).where("role IS NOT NULL").drop("rows")


def tail(df: DataFrame, n: int, *, keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """The last ``n`` rows of each series."""
    if not keys:
        return df.orderBy(F.desc(pos)).limit(n)
    return last_rows(df, n, keys, pos)


def split_tail(df: DataFrame, n: int | None = None, test_ratio: float = 0.2, *, keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """Label the rows of the last ``n`` of each series, all of them by default, as :func:`split_temporal` does."""
    return split_temporal(df if n is None else tail(df, n, keys=keys, pos=pos), test_ratio, keys=keys, pos=pos)


def stride(df: DataFrame, step: int, *, keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """Every ``step``-th row of each series, from the first."""
    return with_ordinal(df, keys, pos).where(F.col("ord") % step == 0).drop("ord", "rows")


def last_days(df: DataFrame, days: int, *, keys: Sequence[str] = (), time: str = "ts",
              closed: str = "both", until: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days up to each series' last row; 0 keeps all.

    ``closed='both'`` includes the row exactly ``days`` old, ``'right'`` does not. ``until``
    is the table whose last rows count, if not ``df`` itself.
    """
    if closed not in ("both", "right"):
        raise ValueError(f"unknown closed {closed!r}")
    if days <= 0:
        return df
    ends = (df if until is None else until).groupBy(*keys).agg(F.max(time).alias("_end"))
    cut = F.col("_end") - F.make_dt_interval(days=F.lit(days))
    inside = F.col(time) >= cut if closed == "both" else F.col(time) > cut
    return attach(df, ends, keys).where(inside).drop("_end")


def top_k(df: DataFrame, by: str, k: int = 15) -> DataFrame:
    """The ``k`` largest rows."""
    return df.orderBy(F.desc_nulls_last(by)).limit(k)
