"""Series packed into one row per chunk, and sums over chunks per series.

Fits of linear models need sums of products of lagged values. A chunk with the few values before it is one row, so
a pass over a fit's data is a narrow job without a shuffle: numpy sums the products of each chunk, a batch returns one
row per series in it, and the shuffle carries those rows only. A long series is many chunks, many series are many rows.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.plans.chunks import CHUNK, halo

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        with tempfile.TemporaryDirectory() as folder:
            tree = Path(folder) / "tree"
            shutil.copytree(root, tree / root.name, ignore=shutil.ignore_patterns("__pycache__"))
            zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gridtide-core-')}/gridtide_core", "zip", tree)
        context.addPyFile(zipped)
        _SHIPPED.add(context.applicationId)
    return spark


def series_of(keys: Sequence[str]) -> Column:
    """The keys as one never-null value; null keys compare as equal inside it."""
    return F.struct(F.lit(0).alias("_"), *keys)


def packed(df: DataFrame, value: str, keys: Sequence[str], pos: str, before: int, size: int = CHUNK) -> DataFrame:
    """One row per series and chunk: ``values`` are the chunk's own ``n`` and up to ``before`` earlier ones, by ``pos``.

    ``first`` and ``last`` are the own positions; ``nulls`` and ``twice`` count own rows without a value or with a position
    that another row has; ``total`` is the sum of the own values.
    """
    rows = df.where(F.col(pos).isNotNull()).select(*keys, F.col(pos).cast("long").alias("at"), F.col(value).cast("double").alias("v"))
    cells = halo(rows, "at", before, size=size).groupBy(series_of(keys).alias("_series"), "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))
    own = cells.withColumn("own", F.filter("cells", lambda c: c["at"] >= F.col("_chunk") * size)).where(F.size("own") > 0)
    return own.select(
        "_series", "_chunk", F.size("own").cast("long").alias("n"), F.get("own", 0)["at"].alias("first"), F.element_at("own", -1)["at"].alias("last"),
        F.size(F.filter("own", lambda c: c["v"].isNull())).alias("nulls"), (F.size("own") - F.size(F.array_distinct(F.col("own.at")))).alias("twice"),
        F.aggregate("own", F.lit(0.0), lambda s, c: s + F.coalesce(c["v"], F.lit(0.0))).alias("total"), F.col("cells.v").alias("values"))


def described(packs: DataFrame, least: Column | int) -> DataFrame:
    """Per series ``rows``, ``start``, ``end``, ``mean`` and ``status``: null if it is dense, complete and has ``least`` rows."""
    table = packs.groupBy("_series").agg(
        F.sum("n").alias("rows"), F.min("first").alias("start"), F.max("last").alias("end"), F.sum("nulls").alias("nulls"),
        F.sum("twice").alias("twice"), (F.sum("total") / F.sum("n")).alias("mean"))
    why = (F.when(F.col("twice") > 0, "rows share a position").when(F.col("rows") != F.col("end") - F.col("start") + 1, "positions are missing")
           .when(F.col("nulls") > 0, "values are missing").when(F.col("rows") < least, "too few rows"))
    return table.withColumn("status", why).drop("nulls", "twice")


def in_one_piece(stats: DataFrame, keys: Sequence[str]) -> None:
    """Without keys a series that cannot be fitted is an error; with keys it becomes a row with a status."""
    if not keys:
        bad = stats.where("status IS NOT NULL").select("status").first()
        if bad:
            raise ValueError(f"the series cannot be fitted: {bad[0]}")


def totals(rows: DataFrame, kernel: Callable[[dict], np.ndarray]) -> DataFrame:
    """``_series, total``: the sum over a series' rows of the vectors that ``kernel`` makes of them (dicts of columns)."""
    shipped(rows.sparkSession)
    shape = f"_series {rows.schema['_series'].dataType.simpleString()}, total array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, tuple[int, np.ndarray]] = {}
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(names)}
                vector = kernel(plain(row))
                series = tuple(row["_series"].as_py().values())
                at, held = sums.get(series, (i, 0.0))
                sums[series] = at, held + vector
            yield with_vectors(batch.column(names.index("_series")), [s[0] for s in sums.values()], [s[1] for s in sums.values()])

    def whole(table: pa.Table) -> pa.Table:
        vector = np.sum([np.asarray(v.values) for v in table.column("total")], axis=0)
        return pa.Table.from_batches([with_vectors(table.column("_series").combine_chunks(), [0], [vector])])

    return rows.mapInArrow(part, shape).groupBy("_series").applyInArrow(whole, shape)


def plain(row: dict) -> dict:
    """Arrow scalars as Python values, lists of numbers as numpy arrays."""
    out = {}
    for name, cell in row.items():
        if cell.is_valid and pa.types.is_list(cell.type):
            out[name] = cell.values.to_numpy(zero_copy_only=False).astype(float) if pa.types.is_primitive(cell.type.value_type) else cell.as_py()
        else:
            out[name] = cell.as_py()
    return out


def with_vectors(series: pa.Array, at: list[int], vectors: list[np.ndarray], name: str = "total") -> pa.RecordBatch:
    """Rows of series (by their places) and vectors."""
    listed = pa.array([np.asarray(v, float) for v in vectors], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([series.take(pa.array(at, pa.int64())), listed], names=["_series", name])


def per_row(rows: DataFrame, answer: Callable[[dict], dict | list[dict]], shape: str) -> DataFrame:
    """``_series`` and the columns of ``shape``, from what ``answer`` makes of each row; several dicts are several rows."""
    shipped(rows.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(shape))
    whole = f"_series {rows.schema['_series'].dataType.simpleString()}, {shape}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at, made = batch.schema.names, [], []
            for i in range(batch.num_rows):
                found = answer(plain({c: batch.column(k)[i] for k, c in enumerate(names)}))
                found = found if isinstance(found, list) else [found]
                at += [i] * len(found)
                made += found
            series = batch.column(names.index("_series")).take(pa.array(at, pa.int64()))
            columns = [pa.array([m[f.name] for m in made], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([series, *columns], names=["_series", *fields.names])
    return rows.mapInArrow(run, whole)


def with_values(df: DataFrame, found: DataFrame, keys: Sequence[str], pos: str, name: str) -> DataFrame:
    """``df`` with the column ``name`` of the row of ``found`` with the same keys and position, or null."""
    other = found.select(*[F.col(k).alias(f"_r_{k}") for k in (*keys, pos)], F.col(name).alias("_found"))
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(pos) == F.col(f"_r_{pos}")]
    return df.join(other, match, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("_found").alias(name))
