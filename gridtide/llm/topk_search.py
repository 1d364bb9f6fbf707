"""Exact highest inner products: columnar branch and bound.

A block of candidates lies in vertical layout, one contiguous row per dimension. For a query the dimensions are taken in
order of its largest components, ``STEP`` at a time: partial scores of the candidates grow, and the norms of what is left
of both vectors bound what can still come (Cauchy-Schwarz). Candidates whose upper bound is below the asked score are
compacted away; the asked score is the k-th best known so far or the k-th best lower bound of the block, whichever is higher.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.shipping import shipped
from gridtide.llm.vector_grid import EXACT, LARGEST, ask, best, dealt, matrix, norms, plain, products, rounds, whole_vectors
from gridtide.session import materialise

STEP = 8        # dimensions between two looks at the bounds
SPARSE = 0.75   # survivors are compacted when fewer than this share is left


def survivors(query: np.ndarray, columns: np.ndarray, masses: np.ndarray, alive: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of candidates among ``alive`` that can be under the ``k`` best scores of ``floor`` or more.

    ``columns`` holds the candidates by dimension, ``masses`` their squared norms; all sums are exact in double precision.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    left = float(query @ query)
    part, mass = np.zeros(len(alive)), masses[alive]
    for lo in range(0, len(order), STEP):
        dims = order[lo:lo + STEP]
        block = columns[dims][:, alive] if len(alive) < columns.shape[1] else columns[dims]
        part = part + query[dims] @ block
        mass = mass - (block * block).sum(axis=0)
        left -= float(query[dims] @ query[dims])
        room = np.sqrt(np.maximum(mass * left, 0)) * (1 + 1e-12)
        if len(part) > k:
            floor = max(floor, np.floor(np.partition(part - room, -k)[-k]))  # scores are whole numbers
        near = part + room >= floor
        if np.count_nonzero(near) < SPARSE * len(near):
            alive, part, mass = alive[near], part[near], mass[near]
    near = part >= floor
    return alive[near], part[near]


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("name", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        rows, asked = matrix(candidates), matrix(queries)
        name, uid = plain(candidates, "id"), plain(candidates, "uid")
        own, floors = plain(queries, "uid"), plain(queries, "floor", -LARGEST)
        exact = norms(rows).max() * max(norms(asked).max(), norms(rows).max()) < EXACT
        columns = np.ascontiguousarray(rows.T.astype(np.float64)) if exact else None
        masses = (columns * columns).sum(axis=0) if exact else None
        everyone, out = np.arange(len(rows)), []
        place = {int(u): i for i, u in enumerate(uid)}
        for i in range(len(asked)):
            at = place.get(int(own[i]))
            alive = everyone if at is None else np.delete(everyone, at)
            if not len(alive):
                continue
            if exact:
                alive, score = survivors(asked[i].astype(np.float64), columns, masses, alive, k, float(floors[i]))
                score = score.astype(np.int64)
            else:  # sums beyond double precision: whole numbers, no bounds
                score = products(asked[i:i + 1], rows[alive])[0]
                alive, score = alive[score >= floors[i]], score[score >= floors[i]]
            top = best(np.zeros(len(alive), np.int64), score, name[alive], uid[alive], k)
            out.append((np.full(len(top), own[i]), alive[top], score[top]))
        if not out:
            return schema.empty_table()
        query, at, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(query), candidates.column("id").combine_chunks().take(pa.array(at)), pa.array(uid[at]), pa.array(score)], schema=schema)
    return run


def top_products(vectors: DataFrame, asks: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` other rows with the highest inner products for every row where ``asks`` holds.

    Components are ``floor(scale * x)`` with x as double, scores whole numbers. Ties go to the smaller id, null ids last.
    Fewer than ``k`` other rows give them all. Vectors that are null, empty or hold null or non-finite components
    take no part; vectors meet those of their own length only. Rows that repeat an id are queries and candidates of their
    own. Components and scores beyond a long saturate. An empty table gives no rows; other columns are not read.
    """
    shipped(vectors.sparkSession)
    rows = whole_vectors(vectors, scale, vector_col, id=F.col(id_col).cast("long"), asks=F.coalesce(asks, F.lit(False)))
    candidates, queries, blocks = dealt(rows, "asks")
    candidates, queries = candidates.select("uid", "id", "width", "vector", "block", "packs", "blocks"), queries.drop("id", "asks")
    shape, known = "query long, name long, uid long, score long", None
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("name"), "uid"))
    for lo, hi in rounds(blocks):
        if known is None:
            asked = queries.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = known.where(F.col("rank") == k).select(F.col("query").alias("uid"), F.col("score").alias("floor"))
            asked = queries.join(floors, "uid", "left")
        found = ask(asked, candidates, lo, hi, _search(k), shape)
        together = found if known is None else found.unionByName(known.drop("rank"))
        known = materialise(together.withColumn("rank", place).where(F.col("rank") <= k), "best")
    names = rows.where("asks").select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    if known is None:
        known = rows.sparkSession.createDataFrame([], shape + ", rank int")
    return known.join(names, "query").select("query_id", "rank", F.col("name").alias(id_col), "score")
