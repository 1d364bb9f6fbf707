"""Integer vectors, and questions about them dealt as a grid of query packs and candidate blocks.

A pack or block holds about ``CELLS`` components, so a task's memory is bounded whatever the table. Candidates are
copied once per pack, queries once per block. Blocks are asked in rounds that grow by ``GROWTH``: every round brings
the best found so far, so what a round returns stays near a few times the asked number, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.session import materialise

CELLS = 1 << 18        # components of a block of candidates
PACK_CELLS = 1 << 16   # components of a pack of queries
GROWTH = 4
LARGEST = np.iinfo(np.int64).max
EXACT = float(1 << 46)  # sums of products below this are exact in double precision, with room for a fraction


def whole_vectors(table: DataFrame, scale: int, vector: str, **columns: Column) -> DataFrame:
    """Written rows ``uid, width, vector`` with ``floor(scale * x)`` per component, and further columns.

    Vectors that are null, empty or hold null or non-finite components are left out; components beyond a long
    saturate. ``uid`` tells rows apart that repeat an id.
    """
    wide = table.select(F.col(vector).cast("array<double>").alias("vector"), *[c.alias(name) for name, c in columns.items()])
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vector") > 0)
    most = float(1 << 62)
    rows = wide.where(F.coalesce(fine, F.lit(False))).withColumns({
        "uid": F.monotonically_increasing_id(), "width": F.size("vector"),
        "vector": F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(most)), F.lit(-most))))})
    return materialise(rows, "whole")


def dealt(rows: DataFrame, asks: str) -> tuple[DataFrame, DataFrame, int]:
    """Candidates with ``block, packs, blocks``, queries (rows where ``asks`` holds) with ``pack, packs, blocks``, most blocks of a width."""
    sizes = materialise(rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(F.expr(asks)).alias("q")).select(
        "width", F.ceil(F.col("n") * F.col("width") / CELLS).alias("blocks"), F.ceil(F.col("q") * F.col("width") / PACK_CELLS).alias("packs")), "sizes")
    sized = rows.join(sizes, "width").where("packs > 0")
    candidates = sized.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    queries = sized.where(asks).withColumn("pack", F.pmod(F.xxhash64("uid", F.lit(7)), F.col("packs")))
    return candidates, materialise(queries, "queries"), sizes.agg(F.max("blocks")).first()[0] or 0


def rounds(blocks: int) -> Iterator[tuple[int, int]]:
    """Ranges of block offsets: one block first, then more and more."""
    lo, hi = 0, 1
    while lo < blocks:
        yield lo, min(hi, blocks)
        lo, hi = hi, hi * GROWTH


def ask(queries: DataFrame, candidates: DataFrame, lo: int, hi: int, answer: Callable, shape: str) -> DataFrame:
    """``answer`` (two Arrow tables to one) for every pack and the blocks at offsets ``lo`` to ``hi`` from its own."""
    offset = F.explode(F.sequence(F.lit(lo).cast("long"), F.least(F.lit(hi).cast("long"), F.col("blocks")) - 1))
    asked = queries.where(F.col("blocks") > lo).withColumn("_o", offset).withColumn("block", F.pmod(F.col("pack") + F.col("_o"), F.col("blocks")))
    given = (candidates.where(F.col("blocks") > lo).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)))
             .where(F.pmod(F.col("block") - F.col("pack"), F.col("blocks")).between(lo, hi - 1)))
    keys = ["width", "pack", "block"]
    return (asked.drop("_o", "packs", "blocks").groupBy(*keys)
            .cogroup(given.drop("packs", "blocks").groupBy(*keys)).applyInArrow(answer, shape))


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    """Vectors as rows of 64-bit integers."""
    flat = table.column(column).combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 1)


def plain(table: pa.Table, column: str, none: int = LARGEST) -> np.ndarray:
    """A long column; null becomes ``none``."""
    return table.column(column).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as 64-bit integers: exact, saturated beyond a long."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if norms(a).max() * norms(b).max() < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    sums = a.astype(object) @ b.astype(object).T  # whole numbers of any size
    return np.clip(sums, -LARGEST, LARGEST).astype(np.int64)


def best(owner: np.ndarray, score: np.ndarray, name: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's ``k`` highest scores, ties to smaller names, then uids; sorted by owner and rank."""
    order = np.lexsort((uid, name, -score, owner))
    of = owner[order]
    begins = np.ones(len(of), bool)
    begins[1:] = of[1:] != of[:-1]
    at = np.arange(len(of))
    return order[at - np.maximum.accumulate(np.where(begins, at, 0)) < k]
