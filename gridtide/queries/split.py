"""Split, cut and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import features, splits as op
from gridtide.queries import bindings as b
from gridtide.queries import sql as q
from gridtide.queries.registry import query, r
from gridtide.schemas import TARGET

P = q.r("p", 6, TARGET)
TRAIN = "floor(n * (1 - 0.2::DOUBLE))"


def known_hours(spark, sf):
    return b.hourly_power(spark, sf).where(F.col(TARGET).isNotNull())


def known_days(spark, sf):
    return b.daily_quantity(spark, sf).where(F.col(TARGET).isNotNull())


@query("split_temporal", q.sql(q.DAILY, select=(
    f"SELECT ts, CASE WHEN o >= {TRAIN} THEN 'test' ELSE 'train' END AS split FROM days")))
def split_temporal(spark, sf):
    return op.split_temporal(known_days(spark, sf)).select("ts", "split")


@query("split_temporal_by_series", q.sql(q.BY_TYPE, select=(
    "SELECT series_id, ts, CASE WHEN i >= floor(n * (1 - 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM "
    "(SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, "
    "count(*) OVER (PARTITION BY series_id) AS n FROM typed WHERE p IS NOT NULL)")))
def split_temporal_by_series(spark, sf):
    known = b.hourly_by_type(spark, sf).where(F.col(TARGET).isNotNull())
    return op.split_temporal(known, keys=b.BY_TYPE).select("series_id", "ts", "split")


@query("split_validation", q.sql(q.DAILY, select=(
    f"SELECT ts, CASE WHEN o >= {TRAIN} THEN 'test' WHEN o >= {TRAIN} - floor({TRAIN} * 0.1::DOUBLE) "
    "THEN 'validation' ELSE 'train' END AS split FROM days")))
def split_validation(spark, sf):
    return op.split_temporal(known_days(spark, sf), val_ratio=0.1).select("ts", "split")


@query("split_tail", q.sql(q.DAILY, select=(
    f"SELECT ts, CASE WHEN o >= {TRAIN} THEN 'test' ELSE 'train' END AS split FROM days")))
def split_tail(spark, sf):
    return op.split_tail(known_days(spark, sf)).select("ts", "split")


@query("split_sequences", q.sql(q.HOURS, select=(
    "SELECT ts, CASE WHEN i - 24 >= floor((n - 24) * (1 - 0.1::DOUBLE)) THEN 'test' ELSE 'train' END AS split "
    "FROM hours WHERE i >= 24")))
def split_sequences(spark, sf):
    from gridtide.plans.chunks import with_ordinal
    rows = with_ordinal(known_hours(spark, sf), ())
    seqs = features.sequences(rows, TARGET, pos="ord").drop("ord", "rows")
    return op.split_temporal(seqs, 0.1).select("ts", "split")


@query("split_cv_folds", q.sql(q.DAILY, select=(
    "SELECT ts, fold, CASE WHEN o < n - (5 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role "
    "FROM days, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE o < n - (4 - fold) * (n // 6)")))
def split_cv_folds(spark, sf):
    return op.cv_folds(known_days(spark, sf)).select("ts", "fold", "role")


@query("tail_n", q.sql(q.DAILY, select=f"SELECT ts, {P} FROM days WHERE o >= n - 1000"))
def tail_n(spark, sf):
    return op.tail(known_days(spark, sf), 1000).select("ts", r(TARGET))


@query("tail_n_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, {P} FROM typed QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 168")))
def tail_n_by_series(spark, sf):
    return op.tail(b.hourly_by_type(spark, sf), 168, keys=b.BY_TYPE).select("series_id", "ts", r(TARGET))


@query("sample_stride", q.sql(q.DAILY, select=f"SELECT ts, {P} FROM days WHERE o % 12 = 0"))
def sample_stride(spark, sf):
    return op.stride(known_days(spark, sf), 12).select("ts", r(TARGET))


@query("filter_last_days", q.sql(q.HOURLY, "ends AS (SELECT max(ts) AS e FROM hourly)", select=(
    f"SELECT 'both' AS closed, ts, {P} FROM hourly, ends WHERE ts >= e - INTERVAL 7 DAY UNION ALL "
    f"SELECT 'right', ts, {P} FROM hourly, ends WHERE ts > e - INTERVAL 7 DAY")))
def filter_last_days(spark, sf):
    table = b.hourly_power(spark, sf)
    cuts = [op.last_days(table, 7, closed=c).select(F.lit(c).alias("closed"), "ts", r(TARGET))
            for c in ("both", "right")]
    return cuts[0].unionByName(cuts[1])


@query("filter_last_days_by_series", q.sql(q.BY_TYPE, select=(
    f"SELECT series_id, ts, {P} FROM (SELECT *, max(ts) OVER (PARTITION BY series_id) AS e FROM typed) "
    "WHERE ts >= e - INTERVAL 7 DAY")))
def filter_last_days_by_series(spark, sf):
    return op.last_days(b.hourly_by_type(spark, sf), 7, keys=b.BY_TYPE).select("series_id", "ts", r(TARGET))
