"""Ordered work on long series without a single-task window.

A window per series sends a whole series to one task. These helpers cut a series into
chunks of a fixed number of positions instead:

* ``halo``: rows near a chunk border are copied into the neighbour chunk, so bounded
  frames (lags, rolling, centred means) see all their rows inside one chunk;
* ``known_neighbours``: the last and next known value of each column, found inside the
  chunk or carried across chunks by a table of one row per chunk;
* ``with_ordinal`` / ``with_row_ordinal``: dense row numbers.

``pos`` is an integer with at most one row per series and value (a slot or an ordinal),
so a chunk holds at most ``size`` rows whatever the skew between series. Rows without a
key form a series of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.session import materialise

CHUNK = 4096         # grid steps: 170 days of hours
ROW_CHUNK = 1 << 16  # raw rows
DRAWN = 16           # sampled rows per part of a crowded bucket
PARTS = 256          # of a crowded bucket; crowded parts are cut again
LEVELS = 4           # of such cuts


def chunk_of(pos: str, size: int = CHUNK) -> Column:
    return F.expr(f"floor(`{pos}` / {size})")


def halo(df: DataFrame, pos: str, before: int, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Give every row to each chunk whose frames reach it (column ``_chunk``)."""
    reach = f"sequence(floor((`{pos}` - {after}) / {size}), floor((`{pos}` + {before}) / {size}))"
    return df.selectExpr("*", f"explode({reach}) AS _chunk")


def own(df: DataFrame, pos: str, size: int = CHUNK) -> DataFrame:
    """Drop the copies made by :func:`halo`."""
    return df.where(f"_chunk = floor(`{pos}` / {size})").drop("_chunk")


def chunk_window(keys: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def chunk_sql(keys: Sequence[str], pos: str) -> str:
    """:func:`chunk_window` as SQL text, for many expressions at once."""
    return f"PARTITION BY {', '.join(f'`{k}`' for k in (*keys, '_chunk'))} ORDER BY `{pos}`"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Inner join on series keys, null matching null, and on further never-null columns."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in (*keys, *on)})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(c) == F.col(f"_r_{c}") for c in on]
    return left.join(named, match).drop(*[f"_r_{c}" for c in (*keys, *on)])


def attach(df: DataFrame, per_series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-series values to every row.

    Without keys the values are one row and become scalar subqueries. With keys it is a
    plain equi-join: the adaptive planner broadcasts the small side only when its
    measured size allows, and splits a hot series otherwise.
    """
    if keys:
        return join_on(df, per_series, keys)
    row = per_series.select(F.struct(*per_series.columns).alias("row")).scalar()
    return df.select("*", *[row.getField(c).alias(c) for c in per_series.columns])


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Rows with ``_chunk`` and ``_series``, the keys as one never-null value.

    Both are plain columns that grouping, joining and windows share, so rows shuffle once; null keys
    compare as equal inside the struct. Rows without a position belong to no chunk and are dropped here,
    on every branch alike.
    """
    placed = df.withColumns({"_chunk": chunk, "_series": F.struct(F.lit(0).alias("_"), *keys)})
    return placed.where("_chunk IS NOT NULL")


def _carried(chunked: DataFrame, table: DataFrame) -> DataFrame:
    """Rows joined to the table with one row per series and chunk."""
    named = table.withColumnsRenamed({"_series": "_r_series", "_chunk": "_r_chunk"})
    match = (F.col("_series") == F.col("_r_series")) & (F.col("_chunk") == F.col("_r_chunk"))
    return chunked.join(named, match).drop("_r_series", "_r_chunk")


def _numbered(chunked: DataFrame, order: Sequence[str]) -> DataFrame:
    """``ord`` and ``rows`` from counts per chunk and row numbers inside chunks."""
    counts = chunked.groupBy("_series", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy("_series")
    earlier = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "_series", "_chunk",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(series).alias("rows"),
    )
    inside = Window.partitionBy("_series", "_chunk").orderBy(*order)
    return (_carried(chunked, bases).withColumn("ord", F.col("_base") + F.row_number().over(inside) - 1)
            .drop("_chunk", "_series", "_base"))


def with_ordinal(df: DataFrame, keys: Sequence[str], pos: str = "slot",
                 size: int = CHUNK) -> DataFrame:
    """Add ``ord`` (0-based row number by ``pos``) and ``rows`` (row count) per series."""
    return _numbered(_chunked(df, keys, chunk_of(pos, size)), [pos])


def last_rows(df: DataFrame, n: int, keys: Sequence[str], pos: str = "slot", size: int = CHUNK) -> DataFrame:
    """The last ``n`` rows of each series: only chunks that can hold them are numbered."""
    chunked = _chunked(df, keys, chunk_of(pos, size))
    counts = chunked.groupBy("_series", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("_series").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    held = counts.select("_series", "_chunk", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after")).where(F.col("_after") < n)
    inside = Window.partitionBy("_series", "_chunk").orderBy(F.desc(pos))
    return (_carried(chunked, held).withColumn("_nth", F.row_number().over(inside)).where(F.col("_nth") + F.col("_after") <= n)
            .drop("_chunk", "_series", "_after", "_nth"))


def with_row_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: int = 3600, most: int = ROW_CHUNK) -> DataFrame:
    """Like :func:`with_ordinal` for rows in any order.

    The first of ``order``, a time or a number, cuts a series into buckets of ``bucket`` seconds or units. A bucket of more
    than ``most`` rows is cut again, about evenly, at quantiles of its rows' full order, so however many rows share an hour,
    a minute or one moment, no task numbers many more than ``most``. Counts per bucket give each bucket's first ordinal. Give
    ``order`` a unique end, or rows of equal order may be numbered either way (and stay in one bucket); the result is written
    once, so that all later steps see one numbering. Rows whose first order is null have no place in the series and are
    dropped: count them before.
    """
    first = F.col(order[0])
    if df.schema[order[0]].dataType.typeName().startswith("timestamp"):
        first = F.unix_micros(first.cast("timestamp")) / 1_000_000
    chunked, crowd = _chunked(df, keys, F.floor(first / bucket)), None
    for _ in range(LEVELS):
        hot = materialise(chunked.groupBy("_series", "_chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most), "hot")
        largest = hot.agg(F.max("_n")).first()[0]
        if largest is None or largest == crowd:  # none, or rows of one order that nothing tells apart
            break
        chunked, crowd = _cut(chunked, hot, order, most), largest
    return materialise(_numbered(chunked, order), "ordered")


def _cut(chunked: DataFrame, hot: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Rows whose ``_chunk`` is a pair (bucket, part): crowded buckets in parts of about ``most`` rows by their order.

    Cuts come from a sample of about ``DRAWN`` rows per part; they steer sizes only. A row's part is the number of cuts
    before it, ``PARTS`` at most.
    """
    place = F.struct(*order)
    named = hot.withColumnsRenamed({"_series": "_r_series", "_chunk": "_r_chunk", "_n": "_crowd"})
    same = (F.col("_series") == F.col("_r_series")) & (F.col("_chunk") == F.col("_r_chunk"))
    share = DRAWN * F.least(F.ceil(F.col("_crowd") / most), F.lit(PARTS)) / F.col("_crowd")
    drawn = (chunked.join(named, same).where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < share * (1 << 30))
             .groupBy("_r_series", "_r_chunk").agg(F.array_sort(F.collect_set(place)).alias("_drawn")))
    cuts = materialise(drawn.select("_r_series", "_r_chunk", F.filter("_drawn", lambda x, i: i % DRAWN == DRAWN - 1).alias("_cuts")), "cuts")
    wide = chunked.join(cuts, same, "left")  # one small row per crowded bucket: broadcast, or a join that splits the crowd
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < place)), F.lit(0))
    return wide.withColumn("_chunk", F.struct(F.col("_chunk").alias("bucket"), part.alias("part"))).drop("_r_series", "_r_chunk", "_cuts")


def known_neighbours(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = "slot",
                     size: int = CHUNK) -> DataFrame:
    """Add ``_prev_<c>`` and ``_next_<c>``: structs (at, v) of the nearest known values.

    Both include the row itself. One shuffle and one sort per direction serve all columns
    (a frame that ends at the partition's end would be recomputed for every row); values from
    other chunks come from a table with one row per series and chunk.
    """
    chunked = _chunked(df, keys, chunk_of(pos, size))

    def known(c: str) -> str:
        return f"CASE WHEN `{c}` IS NOT NULL THEN struct(`{pos}` AS at, CAST(`{c}` AS DOUBLE) AS v) END"

    edges = chunked.groupBy("_series", "_chunk").agg(
        *[F.expr(f"max({known(c)}) AS `_last_{c}`") for c in cols],
        *[F.expr(f"min({known(c)}) AS `_first_{c}`") for c in cols],
    )
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carry = edges.selectExpr(
        "_series", "_chunk",
        *[f"last(`_last_{c}`, true) OVER (PARTITION BY _series ORDER BY _chunk {before}) AS `_left_{c}`" for c in cols],
        *[f"last(`_first_{c}`, true) OVER (PARTITION BY _series ORDER BY _chunk DESC {before}) AS `_right_{c}`" for c in cols],
    )
    inside = f"PARTITION BY _series, _chunk ORDER BY `{pos}`"
    upto = f"OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    back = f"OVER ({inside} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return _carried(chunked, carry).selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"coalesce(last({known(c)}, true) {upto}, `_left_{c}`) AS `_prev_{c}`" for c in cols],
        *[f"coalesce(last({known(c)}, true) {back}, `_right_{c}`) AS `_next_{c}`" for c in cols],
    )


def reaching_neighbours(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = "slot", before: int = 0,
                        size: int = CHUNK) -> DataFrame:
    """:func:`halo` and :func:`known_neighbours` at once: rows in every chunk whose frames reach ``before`` positions
    back to them, with ``_series``, ``_chunk``, ``_prev_<c>`` and ``_next_<c>``.

    What a chunk cannot see is carried: the last known value before its first copied row and the first one after its end.
    Windows over ``_series, _chunk`` that follow share this one shuffle of the rows; drop the copies with :func:`own`.
    """
    home, reach = f"floor(`{pos}` / {size})", f"floor((`{pos}` + {before}) / {size})"
    placed = df.where(F.col(pos).isNotNull()).withColumn("_series", F.struct(F.lit(0).alias("_"), *keys))

    def known(c: str) -> str:
        return f"CASE WHEN `{c}` IS NOT NULL THEN struct(`{pos}` AS at, CAST(`{c}` AS DOUBLE) AS v) END"

    sides = placed.groupBy("_series", F.expr(home).alias("_home"), F.expr(reach).alias("_reach")).agg(
        *[F.expr(f"max({known(c)}) AS `_last_{c}`") for c in cols], *[F.expr(f"min({known(c)}) AS `_first_{c}`") for c in cols])
    # rows that reach chunk k lie before the copies of the chunks after k; rows of chunk k lie after all chunks before it
    lasts = sides.selectExpr("_series", "_reach AS _chunk", "false AS _own", *[f"`_last_{c}`" for c in cols])
    firsts = sides.selectExpr("_series", "_home AS _chunk", "true AS _own", *[f"`_first_{c}`" for c in cols])
    edges = lasts.unionByName(firsts, allowMissingColumns=True).groupBy("_series", "_chunk").agg(
        F.max("_own").alias("_own"), *[F.max(f"_last_{c}").alias(f"_last_{c}") for c in cols],
        *[F.min(f"_first_{c}").alias(f"_first_{c}") for c in cols])
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carry = edges.selectExpr(
        "_series", "_chunk", "_own",
        *[f"last(`_last_{c}`, true) OVER (PARTITION BY _series ORDER BY _chunk {earlier}) AS `_left_{c}`" for c in cols],
        *[f"last(`_first_{c}`, true) OVER (PARTITION BY _series ORDER BY _chunk DESC {earlier}) AS `_right_{c}`" for c in cols],
    ).where("_own").drop("_own")
    inside = f"PARTITION BY _series, _chunk ORDER BY `{pos}`"
    upto = f"OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    back = f"OVER ({inside} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    copied = placed.selectExpr("*", f"explode(sequence({home}, {reach})) AS _chunk")
    return _carried(copied, carry).selectExpr(
        *[f"`{c}`" for c in df.columns], "_series", "_chunk",
        *[f"coalesce(last({known(c)}, true) {upto}, `_left_{c}`) AS `_prev_{c}`" for c in cols],
        *[f"coalesce(last({known(c)}, true) {back}, `_right_{c}`) AS `_next_{c}`" for c in cols],
    )
