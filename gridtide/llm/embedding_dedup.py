"""Near-duplicate vectors: an exact range join in a metric space.

Cosine c between vectors means distance ``sqrt(2 - 2c)`` between their unit vectors. Pivots cut a label's
space into cells (nearest pivot); by the triangle inequality a vector can have a partner in a cell only if
that pivot is at most two radii farther than its own, so it is copied there and each cell joins alone.
A cell that is still large gets pivots of its own in the same way, so cells stay small at any number of vectors.
Equal vectors count once. A cell reports counts and one link per vector to its group's root, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import connected_components
from gridtide.llm.shipping import shipped
from gridtide.session import materialise

CELL = 2000         # vectors per pivot, about
MAX_PIVOTS = 256    # per label and level
LEVELS = 4          # of cells within cells; at 256 pivots a level the last one is out of reach
DEAL = 50_000       # vectors of a label that one task assigns to cells
BLOCK = 4000        # vectors of a cell that one task compares with as many


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # tiny and huge vectors keep their norms finite
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _assign(cosine: float, unit: bool):
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    schema = pa.schema([("part", pa.int64()), ("cell", pa.int32()), ("home", pa.bool_()), ("cid", pa.int64()),
                        ("mult", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def run(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return schema.empty_table()
        n = vectors.num_rows
        points = vectors.column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1) if unit else _unit(vectors.column("vector"))
        home = vectors.column("home").to_numpy(zero_copy_only=False)
        if pivots.num_rows:
            base = _unit(pivots.column("vector"))
            apart = np.sqrt(np.maximum(2 - 2 * base @ base.T, 0))
        else:
            base, apart = np.zeros((1, points.shape[1])), np.zeros((1, 1))
        rows, cells, homes = [], [], []
        for lo in range(0, n, 4096):
            far = np.sqrt(np.maximum(2 - 2 * points[lo:lo + 4096] @ base.T, 0))
            own = far.argmin(axis=1)
            near = far[np.arange(len(own)), own]
            edge = (far**2 - near[:, None] ** 2) / (2 * np.maximum(apart[own], 1e-12))  # distance to the border between two pivots
            near_cell = (far - near[:, None] <= 2 * radius) & (edge <= radius)
            near_cell[np.arange(len(own)), own] = True
            row, cell = np.nonzero(near_cell)
            rows.append(row + lo)
            cells.append(cell)
            homes.append((cell == own[row]) & home[row + lo])  # a copy stays one in the cells within its cell
        row, cell, own_cell = np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)
        take = pa.array(row)
        flat = pa.array(points[row].reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * points.shape[1], pa.int32()), flat)
        return pa.table([vectors.column("part").combine_chunks().take(take), pa.array(cell.astype(np.int32)),
                         pa.array(own_cell), vectors.column("cid").combine_chunks().take(take),
                         vectors.column("mult").combine_chunks().take(take), lists], schema=schema)
    return run


def _compare(cosine: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        role = table.column("probe").to_numpy(zero_copy_only=False)
        cid, mult = table.column("cid").to_numpy(), table.column("mult").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        points = flat.reshape(len(cid), -1)
        home, probe = np.flatnonzero(~role), np.flatnonzero(role)
        near = np.zeros((len(home), len(probe)), bool)
        for lo in range(0, len(home), 512):
            near[lo:lo + 512] = points[home[lo:lo + 512]] @ points[probe].T >= cosine
        near &= cid[home][:, None] != cid[probe]
        links = near @ mult[probe]
        top = np.iinfo(np.int64).max
        left, right = cid[home].copy(), cid[probe].copy()
        while near.any():  # smallest id over links, until nothing changes
            new_left, new_right = left.copy(), right.copy()
            for lo in range(0, len(home), 512):
                part = near[lo:lo + 512]
                new_left[lo:lo + 512] = np.minimum(left[lo:lo + 512], np.where(part, right, top).min(axis=1))
                new_right = np.minimum(new_right, np.where(part, left[lo:lo + 512, None], top).min(axis=0))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        moved = right != cid[probe]
        return pa.table([pa.array(np.concatenate([cid[home], cid[probe][moved]])),
                         pa.array(np.concatenate([links, np.zeros(int(moved.sum()), np.int64)])),
                         pa.array(np.concatenate([left, right[moved]]))], schema=schema)
    return run


def _cells(points: DataFrame, cosine: float, level: int) -> DataFrame:
    """``points(part, home, cid, mult, vector)`` dealt to the cells of their parts, as a written table."""
    sizes = materialise(points.groupBy("part").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
                        .withColumns({"pivots": F.when(F.col("homes") > 2 * CELL, F.least(F.ceil(F.col("homes") / CELL), F.lit(MAX_PIVOTS))).otherwise(0),
                                      "salts": F.ceil(F.col("n") / DEAL)}), "sizes")
    sized = points.join(sizes, "part")
    # pivots: about so many of each part, by hash; a part's number may vary a little, results do not
    lot = F.pmod(F.xxhash64("cid", F.lit(5 + level)), F.lit(1_000_000))
    drawn = sized.where(F.col("home") & (F.col("pivots") > 0) & (lot < F.col("pivots") * 1_000_000 / F.col("homes")))
    drawn = materialise(drawn.select("part", "salts", "vector"), "pivots")
    dealt = sized.select("part", F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt"), "home", "cid", "mult", "vector")
    everywhere = drawn.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "vector")
    shape = "part long, cell int, home boolean, cid long, mult long, vector array<double>"
    placed = dealt.groupBy("part", "salt").cogroup(everywhere.groupBy("part", "salt")).applyInArrow(_assign(cosine, level > 0), shape)
    return materialise(placed, "cells")


def _small_cells(points: DataFrame, cosine: float) -> DataFrame:
    """Cells of ``points``; those with very many vectors of their own are parts of the next level."""
    placed = _cells(points, cosine, 0)
    for level in range(1, LEVELS):
        homes = placed.groupBy("part", "cell").agg(F.count_if("home").alias("homes"))
        crowded = materialise(homes.where(F.col("homes") > 4 * CELL).select("part", "cell"), "crowded")
        if crowded.isEmpty():
            break
        inner = placed.join(crowded, ["part", "cell"], "left_semi")
        split = _cells(inner.select(F.xxhash64("part", "cell").alias("part"), "home", "cid", "mult", "vector"), cosine, level)
        placed = placed.join(crowded, ["part", "cell"], "left_anti").unionByName(split)
        if level + 1 < LEVELS:
            placed = materialise(placed, "cells")
    return placed


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per row of ``vectors``.

    Two vectors link when their labels are equal and not null, their lengths equal, and their cosine in
    double precision is ``cosine`` or more. Vectors that are null, empty, zero, or hold a null or non-finite
    value, or have no label, link with nothing. ``n_links`` counts the other rows linked directly, ``component_id``
    is the smallest id reachable (nulls give no name), ``kept`` tells whether it is the row's own. Rows that
    repeat an id are vectors of their own. An empty table gives no rows; other columns are not read.
    """
    shipped(vectors.sparkSession)
    table = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    table = table.withColumn("usable", _usable(F.col("vector")) & F.col("label").isNotNull())
    classes = (table.where("usable").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
               .withColumn("cid", F.monotonically_increasing_id()))
    classes = materialise(classes.withColumn("part", F.xxhash64("label", F.size("vector"))), "classes")
    placed = _small_cells(classes.select("part", F.lit(True).alias("home"), "cid", "mult", "vector"), cosine)

    counts = placed.groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cells = placed.join(counts, ["part", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    homes = cells.where("home").select("part", "cell", F.col("own").alias("a"), F.explode(every).alias("b"), "cid", "mult", "vector", F.lit(False).alias("probe"))
    probes = cells.select("part", "cell", F.explode(every).alias("a"), F.col("own").alias("b"), "cid", "mult", "vector", F.lit(True).alias("probe"))
    found = materialise(homes.unionByName(probes).groupBy("part", "cell", "a", "b").applyInArrow(_compare(cosine), "cid long, links long, root long"), "found")
    groups = connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = (classes.join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    names = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(names, "root").select("label", "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    fine = table.where("usable").join(known, ["label", "vector"]).select("id", "links", "component")
    rest = table.where("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return fine.unionByName(rest).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                                         F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
