"""Hard negatives: anchors of a cluster share one list of candidates.

Anchors are clustered by direction. For a cluster the candidates are sorted once by the highest inner product that any
direction of the cluster could reach, ``norm * cos(angle to the centre - widest member)``. Every member walks that list
with its exact scores until the next bound times its own norm is below the worst score it still needs. The first walk finds
the positives (best rows of the anchor's label), the second the best rows of other labels under a cap for every positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.shipping import shipped
from gridtide.llm.vector_grid import LARGEST, ask, best, dealt, matrix, norms, plain, products, rounds, whole_vectors
from gridtide.session import materialise

MEMBERS = 32        # anchors of a cluster, about
TURNS = 5           # of the clustering; the clusters steer the cost only
FIRST, MOST = 256, 4096  # candidates of a list that are scored in one go
SLACK = 1e-6        # of angles


def _units(rows: np.ndarray) -> np.ndarray:
    length = norms(rows)
    return rows / np.where(length > 0, length, 1)[:, None]


def cluster(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Cluster numbers by direction: spherical k-means from the first rows."""
    units = _units(rows)
    centres = units[:wanted]
    for turn in range(TURNS):
        of = (units @ centres.T).argmax(axis=1)
        if turn == TURNS - 1:
            break
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        centres = _units(sums)
    return of


def _clusters(table: pa.Table) -> pa.Table:
    order = np.argsort(plain(table, "uid"))
    of = np.zeros(len(order), np.int64)
    of[order] = cluster(matrix(table)[order], -(-len(order) // MEMBERS))
    return pa.table([table.column("uid").combine_chunks(), pa.array(of)], schema=pa.schema([("uid", pa.int64()), ("cluster", pa.int64())]))


@dataclass
class Candidates:
    rows: np.ndarray
    label: np.ndarray
    name: np.ndarray
    uid: np.ndarray


def shared_list(members: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by falling bound, and the bounds: no member of norm 1 scores higher."""
    units, length = _units(members), norms(rows)
    centre = units.sum(axis=0)
    centre = centre / max(float(np.sqrt(centre @ centre)), 1e-300)
    turned = units[norms(members) > 0] @ centre
    widest = float(np.arccos(np.clip(turned, -1, 1)).max(initial=0)) + SLACK
    angle = np.arccos(np.clip(_units(rows) @ centre, -1, 1))
    bound = length * (np.cos(np.maximum(angle - widest, 0)) + 1e-9)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(members: np.ndarray, label: np.ndarray, own: np.ndarray, caps: np.ndarray, floors: np.ndarray, given: Candidates,
         same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member * asked + number, candidate, score): the ``k`` best candidates between floor and cap for everything asked.

    ``caps`` and ``floors`` are matrices of member and number; a floor above its cap asks for nothing.
    """
    asked, floors = caps.shape[1], floors.copy()
    active = floors <= caps
    length = norms(members)
    order, bound = shared_list(members, given.rows)
    owner, at, score = (np.zeros(0, np.int64) for _ in range(3))
    lo, size = 0, FIRST
    while lo < len(order):
        reach = bound[lo] * length
        active &= reach[:, None] + np.abs(reach)[:, None] * 1e-9 >= floors  # certified: nothing further on can score more
        alive = np.flatnonzero(active.any(axis=1))
        if not len(alive):
            break
        part = order[lo:lo + size]
        found = products(members[alive], given.rows[part])
        fits = ((label[alive][:, None] == given.label[part]) == same) & (own[alive][:, None] != given.uid[part])
        for number in range(asked):
            low, high = floors[alive, number][:, None], caps[alive, number][:, None]
            row, col = np.nonzero(fits & active[alive, number][:, None] & (found <= high) & (found >= low))
            owner = np.concatenate([owner, alive[row] * asked + number])
            at, score = np.concatenate([at, part[col]]), np.concatenate([score, found[row, col]])
        top = best(owner, score, given.name[at], given.uid[at], k)
        owner, at, score = owner[top], at[top], score[top]
        full = np.flatnonzero(owner[k - 1:] == owner[:len(owner) - k + 1]) + k - 1 if len(owner) >= k else np.zeros(0, np.int64)
        floors.reshape(-1)[owner[full]] = np.maximum(floors.reshape(-1)[owner[full]], score[full])
        lo, size = lo + size, min(2 * size, MOST)
    return owner, at, score


def least_of(cap: np.ndarray, percent: int) -> np.ndarray:
    """The smallest whole number of ``percent`` percent of ``cap`` or more."""
    return cap // 100 * percent - (-(cap % 100 * percent) // 100)


def _mine(same: bool, k: int, percent: int | None):
    schema = pa.schema([("query", pa.int64()), ("number", pa.int32()), ("name", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return schema.empty_table()
        given = Candidates(matrix(candidates), plain(candidates, "label"), plain(candidates, "id"), plain(candidates, "uid"))
        rows, label, own, of = matrix(anchors), plain(anchors, "label"), plain(anchors, "uid"), plain(anchors, "cluster")
        listed = anchors.column("caps").to_pylist(), anchors.column("floors").to_pylist()
        width = max(map(len, listed[0]))
        caps, floors = np.full((len(rows), width), -LARGEST), np.full((len(rows), width), LARGEST)  # more than is asked: nothing
        for i, (c, f) in enumerate(zip(*listed)):
            caps[i, :len(c)] = c
            floors[i, :len(c)] = [-LARGEST if x is None else x for x in f]
            if percent is not None:
                floors[i, :len(c)] = np.maximum(floors[i, :len(c)], least_of(caps[i, :len(c)], percent))
        out = []
        for one in np.unique(of):
            mine = np.flatnonzero(of == one)
            owner, at, score = walk(rows[mine], label[mine], own[mine], caps[mine], floors[mine], given, same, k)
            out.append((own[mine[owner // width]], owner % width, at, score))
        query, number, at, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(query), pa.array(number.astype(np.int32)), candidates.column("id").combine_chunks().take(pa.array(at)),
                         pa.array(given.uid[at]), pa.array(score)], schema=schema)
    return run


def _rounds(anchors: DataFrame, candidates: DataFrame, blocks: int, same: bool, k: int, percent: int | None) -> DataFrame:
    """Written rows ``query, number, name, uid, score, rank`` over all blocks, for anchors with ``caps``."""
    place = F.row_number().over(Window.partitionBy("query", "number").orderBy(F.desc("score"), F.asc_nulls_last("name"), "uid"))
    shape, known = "query long, number int, name long, uid long, score long", None
    for lo, hi in rounds(blocks):
        if known is None:
            asked = anchors.withColumn("floors", F.transform("caps", lambda c: F.lit(None).cast("long")))
        else:
            reached = known.where(F.col("rank") == k).groupBy(F.col("query").alias("uid")).agg(
                F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("reached"))
            asked = anchors.join(reached, "uid", "left").withColumn("floors", F.transform("caps", lambda c, i: F.col("reached")[i])).drop("reached")
        found = ask(asked, candidates, lo, hi, _mine(same, k, percent), shape)
        together = found if known is None else found.unionByName(known.drop("rank"))
        known = materialise(together.withColumn("rank", place).where(F.col("rank") <= k), "mined")
    return known if known is not None else anchors.sparkSession.createDataFrame([], shape + ", rank int")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds.

    A score is the inner product of components ``floor(scale * x)``, x as double. An anchor's positives are the
    ``positives`` best other rows of its label; the negatives of a positive are the ``negatives`` best rows of other labels with
    ``percent * positive_score <= 100 * negative_score <= 100 * positive_score``, so a positive with a score below 0 has none.
    Ties go to the smaller id, null ids last; fewer rows give all. Rows with a null label, or a vector that is null, empty or
    holds null or non-finite components, take no part; vectors meet those of their own length only. Rows that repeat an id
    are anchors and candidates of their own. An empty table gives no rows; other columns are not read.
    """
    shipped(vectors.sparkSession)
    known = vectors.where(F.col(label_col).isNotNull())
    rows = whole_vectors(known, scale, vector_col, id=F.col(id_col).cast("long"), label=F.col(label_col).cast("long"),
                         asks=F.coalesce(anchors, F.lit(False)))
    candidates, asking, blocks = dealt(rows, "asks")
    candidates = candidates.select("uid", "id", "label", "width", "vector", "block", "packs", "blocks")
    grouped = asking.groupBy("width", "pack").applyInArrow(_clusters, "uid long, cluster long")
    asking = materialise(asking.drop("asks").join(grouped, "uid"), "clustered")

    first = asking.drop("id").withColumn("caps", F.array(F.lit(LARGEST)))
    near = _rounds(first, candidates, blocks, True, positives, None).select(
        "query", (F.col("rank") - 1).alias("number"), F.col("name").alias("positive_id"), F.col("score").alias("positive_score"))
    caps = near.groupBy(F.col("query").alias("uid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "positive_score"))), lambda x: x["positive_score"]).alias("caps"))
    second = asking.drop("id").join(caps, "uid")
    far = _rounds(second, candidates, blocks, False, negatives, percent).select(
        "query", "number", "rank", F.col("name").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select(F.col("uid").alias("query"), F.col("id").alias("anchor_id"))
    return near.join(far, ["query", "number"]).join(names, "query").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
