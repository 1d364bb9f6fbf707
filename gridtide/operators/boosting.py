"""Gradient-boosted regression trees over feature columns, with penalties on leaf values and a stop while growing.

Features are binned at train quantiles once; rows are packed into blobs of bytes. A level of a tree is one pass: every task
adds up gradients by node, feature and bin, and the sums (a bounded table, whatever the data) give the best splits. The
predictions so far travel with the packs and are renewed every few trees, so a pass evaluates a few trees only. The
validation error of each round comes with the first pass of the next one, and growing ends ``patience`` rounds after the best;
the model keeps the trees up to the best.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.plans.chunks import with_ordinal
from gridtide.plans.packs import shipped
from gridtide.session import materialise

# Default parameters of the boosted-tree forecaster and its patience.
TREE_PARAMS = {"rounds": 500, "depth": 6, "rate": 0.05, "rows_share": 0.8, "features_share": 0.8, "least_rows": 5.0,
               "l1": 0.1, "l2": 1.0, "seed": 42, "bins": 64}
PATIENCE = 30
PACK_ROWS = 1 << 15
RENEW = 10          # trees after which the packs carry new predictions
DIRECT = 8          # packs whose sums go to the driver as they are; more are added up by feature first
NODE = "tree int, node int, depth int, feature string, threshold double, gain double, cover double, left int, right int, value double"


@dataclass
class Tree:
    """Nodes in the order they were made; ``feature`` -1 is a leaf; a value up to the threshold, or null, goes left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, value: float, cover: float, depth: int) -> int:
        for column, cell in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                             (self.value, value), (self.gain, 0.0), (self.cover, cover), (self.depth, depth)):
            column.append(cell)
        return len(self.feature) - 1

    def nodes(self, cells: np.ndarray, binned: bool) -> np.ndarray:
        """The node each row ends in; ``cells`` has a row per feature."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        cut = np.array(self.bin if binned else self.threshold)
        at = np.zeros(cells.shape[1], np.int64)
        for _ in range(max(self.depth, default=0)):
            live = np.flatnonzero(feature[at] >= 0)
            node = at[live]
            beyond = cells[feature[node], live] > cut[node]  # not a number goes left
            at[live] = np.where(beyond, right[node], left[node])
        return at

    def values(self, cells: np.ndarray, binned: bool) -> np.ndarray:
        return np.array(self.value)[self.nodes(cells, binned)]


def drawn(share: float, n: int, *seed: int) -> np.ndarray:
    """Which of ``n`` rows take part, by a fixed draw for each pack and round."""
    return np.random.default_rng(seed).random(n) < share if share < 1 else np.ones(n, bool)


def leaf_value(gradient, rows, l1: float, l2: float):
    """The value that minimises the penalised squared loss of rows with this sum of gradients."""
    return -np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0) / (rows + l2)


def score(gradient, rows, l1: float, l2: float):
    """Twice what the best value gains."""
    return np.maximum(np.abs(gradient) - l1, 0) ** 2 / (rows + l2)


def best_splits(sums: np.ndarray, params: Mapping) -> dict[int, tuple]:
    """For one feature and each node (gain, bin, left and right sums) of its best split; ``sums`` is node x bin x (gradient, rows)."""
    out = {}
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:]
    right = whole - left
    penalties = params["l1"], params["l2"]
    gain = 0.5 * (score(left[..., 0], left[..., 1], *penalties) + score(right[..., 0], right[..., 1], *penalties)
                  - score(whole[..., 0], whole[..., 1], *penalties))
    gain[(left[..., 1] < params["least_rows"]) | (right[..., 1] < params["least_rows"])] = -np.inf
    for node in range(len(sums)):
        b = int(gain[node].argmax())
        if gain[node, b] > 1e-12:
            out[node] = float(gain[node, b]), b, left[node, b].tolist(), right[node, b].tolist()
    return out


def _packed(table: DataFrame, features: Sequence[str], target: str, held: str | None, bins: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Written packs of binned rows and the cuts of every feature: quantiles of the train rows."""
    train = table if held is None else table.where(~F.col(held))
    shares = [i / bins for i in range(1, bins)]
    found = train.agg(F.count(F.lit(1)), *[F.percentile_approx(F.col(c).cast("double"), shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(features)]).first()
    cuts = [np.unique(np.array([x for x in found[i + 1] or [] if x is not None and math.isfinite(x)], float)) for i in range(len(features))]
    rows = table.where(F.col(target).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"),
        (F.lit(False) if held is None else F.coalesce(F.col(held), F.lit(False))).alias("held"))
    schema = pa.schema([("pack", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), ("y", pa.binary()), ("held", pa.binary())])

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(lo, PACK_ROWS)
                cells = np.stack([np.searchsorted(cuts[i], part.column(i).to_numpy(zero_copy_only=False).astype(float), side="left") for i in range(len(cuts))])
                missing = np.stack([np.isnan(part.column(i).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(cuts))])
                cells[missing] = 0
                y = part.column(len(cuts)).to_numpy(zero_copy_only=False)
                held_rows = part.column(len(cuts) + 1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([cells.astype(np.uint8).tobytes()], pa.binary()),
                                                  pa.array([y.astype(float).tobytes()], pa.binary()), pa.array([held_rows.astype(np.uint8).tobytes()], pa.binary())], schema=schema)

    shape = "pack long, n long, cells binary, y binary, held binary"
    few = max(1, -(-found[0] // PACK_ROWS))  # small tables in few tasks; large ones stay as they are read
    packs = rows.coalesce(few).mapInArrow(blobs, shape).withColumn("pack", F.monotonically_increasing_id())
    return materialise(packs, "packs"), cuts


def _rows_of(batch: pa.RecordBatch, i: int, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pack, cells, values, held out, predictions) of a pack."""
    n = batch.column("n")[i].as_py()
    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    return batch.column("pack")[i].as_py(), read("cells", np.uint8).reshape(width, n), read("y", float), read("held", np.uint8).astype(bool), read("p", float)


@dataclass
class TreeForecaster:
    """Boosted trees; ``history`` holds (round, validation error) of a fit with held-out rows."""

    features: Sequence[str]
    target: str
    params: Mapping[str, float] = field(default_factory=dict)
    trees: list[Tree] = field(default_factory=list)
    base: float | None = None
    history: list[tuple[int, float]] = field(default_factory=list)

    def __post_init__(self):
        unknown = set(self.params) - set(TREE_PARAMS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if not 2 <= {**TREE_PARAMS, **self.params}["bins"] <= 256:
            raise ValueError("2 to 256 bins")

    def fit(self, table: DataFrame, held: str | None = None, patience: int = PATIENCE) -> "TreeForecaster":
        """Fit on the rows with a target where the boolean column ``held`` is not true; with held-out rows growing stops early.

        Null features count as smaller than all values.
        """
        shipped(table.sparkSession)
        params = {**TREE_PARAMS, **self.params}
        width = len(self.features)
        packs, cuts = _packed(table, self.features, self.target, held, int(params["bins"]))
        start = packs.select("n").agg(F.count("*")).first()[0]
        many = start > DIRECT
        train = table.where(F.col(self.target).isNotNull() & (F.lit(True) if held is None else ~F.coalesce(F.col(held), F.lit(False))))
        base = train.agg(F.avg(F.col(self.target).cast("double"))).first()[0]
        if base is None:
            raise ValueError("no rows to learn from")
        self.base, self.trees, self.history = float(base), [], []
        packs = self._renewed(packs.withColumn("p", F.lit(None).cast("binary")), [], width)
        done, best = 0, (math.inf, 0)
        for turn in range(int(params["rounds"])):
            rng = np.random.default_rng((int(params["seed"]), turn))
            chosen = np.sort(rng.permutation(width)[:max(1, round(params["features_share"] * width))])
            if len(self.trees) - done >= RENEW:
                packs = self._renewed(packs, self.trees[done:], width)
                done = len(self.trees)
            tree, error = self._grow(packs, self.trees[done:], chosen, cuts, params, turn, many, held is not None)
            if held is not None and turn:
                self.history.append((turn, error))
                best = min(best, (error, turn))
                if turn - best[1] >= patience:
                    break
            self.trees.append(tree)
        else:
            if held is not None:
                self.history.append((len(self.trees), self._error(packs, self.trees[done:], width)))
        if self.history:
            kept = best_iteration([e for _, e in self.history], patience)
            self.trees = self.trees[:kept]
        return self

    def _renewed(self, packs: DataFrame, trees: list[Tree], width: int) -> DataFrame:
        """Packs with the predictions after some more trees."""
        base = self.base
        names = ["pack", "n", "cells", "y", "held", "p"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    n = batch.column("n")[i].as_py()
                    cell = batch.column("p")[i]
                    p = np.frombuffer(cell.as_buffer(), float).copy() if cell.is_valid else np.full(n, base)
                    cells = np.frombuffer(batch.column("cells")[i].as_buffer(), np.uint8).reshape(width, n)
                    for tree in trees:
                        p += tree.values(cells, True)
                    out.append(p.tobytes())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(out, pa.binary())], names=names)
        return materialise(packs.select(*names).mapInArrow(run, "pack long, n long, cells binary, y binary, held binary, p binary"), "packs")

    def _error(self, packs: DataFrame, recent: list[Tree], width: int) -> float:
        """Mean squared error of the held-out rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = []
                for i in range(batch.num_rows):
                    _, cells, y, held, p = _rows_of(batch, i, width)
                    error = y - p - sum((t.values(cells, True) for t in recent), np.zeros(len(y)))
                    told.append((float((error[held] ** 2).sum()), float(held.sum())))
                yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told]), pa.array([t[1] for t in told])], names=["s", "n"])
        s, n = packs.mapInArrow(run, "s double, n double").agg(F.sum("s"), F.sum("n")).first()
        return s / n if n else math.nan

    def _grow(self, packs: DataFrame, recent: list[Tree], chosen: np.ndarray, cuts, params: dict, turn: int, many: bool, watch: bool) -> tuple[Tree, float]:
        """One more tree, and the validation error before it."""
        tree, width, bins = Tree(), len(self.features), int(params["bins"])
        tree.add(0.0, 0.0, 0)
        level, error = [0], math.nan
        for depth in range(int(params["depth"])):
            found, told = self._sums(packs, recent, tree, level, chosen, width, bins, params, turn, many, watch and depth == 0)
            error = error if depth else told
            if depth == 0:
                if not found["rows"]:
                    break
                tree.value[0], tree.cover[0] = float(params["rate"] * leaf_value(found["gradient"], found["rows"], params["l1"], params["l2"])), found["rows"]
            deeper = []
            for place, node in enumerate(level):
                options = [(split[0], -f, split) for f, nodes in found["splits"].items() if (split := nodes.get(place))]
                if not options:
                    continue
                gain, f, split = max(options, key=lambda o: (o[0], o[1]))
                f = -f
                tree.feature[node], tree.bin[node], tree.gain[node] = f, split[1], gain
                tree.threshold[node] = float(cuts[f][split[1]])
                for side, (g, n) in (("left", split[2]), ("right", split[3])):
                    child = tree.add(float(params["rate"] * leaf_value(g, n, params["l1"], params["l2"])), n, depth + 1)
                    getattr(tree, side)[node] = child
                    deeper.append(child)
            level = deeper
            if not level:
                break
        return tree, error

    def _sums(self, packs, recent, tree, level, chosen, width, bins, params, turn, many, watch) -> tuple[dict, float]:
        """Best splits per feature and place in the level, totals of the first place, and the validation error."""
        place = np.full(len(tree.feature), -1)
        place[level] = np.arange(len(level))
        rows_share, seed = params["rows_share"], int(params["seed"])
        shape = "feature int, sums array<double>"

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(chosen), len(level) * bins, 2))
            told = np.zeros(2)
            for batch in batches:
                for i in range(batch.num_rows):
                    pack, cells, y, held, p = _rows_of(batch, i, width)
                    for earlier in recent:
                        p = p + earlier.values(cells, True)
                    if watch:
                        told += ((y - p)[held] ** 2).sum(), held.sum()
                    at = place[tree.nodes(cells, True)]
                    live = np.flatnonzero((at >= 0) & ~held & drawn(rows_share, len(y), seed, turn, pack))
                    gradient, at = (p - y)[live], at[live] * bins
                    for k, f in enumerate(chosen):
                        cell = at + cells[f, live]
                        sums[k, :, 0] += np.bincount(cell, gradient, len(level) * bins)
                        sums[k, :, 1] += np.bincount(cell, minlength=len(level) * bins)
            yield pa.RecordBatch.from_arrays([pa.array([*chosen.tolist(), -1], pa.int32()),
                                              pa.array([*[s.ravel() for s in sums], told], pa.list_(pa.float64()))], names=["feature", "sums"])

        def split(feature: int, sums: np.ndarray) -> str:
            shaped = sums.reshape(len(level), bins, 2)
            return json.dumps({"splits": best_splits(shaped, params), "whole": shaped[0].sum(axis=0).tolist()})

        def whole(table: pa.Table) -> pa.Table:
            feature = table.column("feature")[0].as_py()
            sums = np.sum([np.asarray(v.values) for v in table.column("sums")], axis=0)
            told = json.dumps(sums.tolist()) if feature < 0 else split(feature, sums)
            return pa.table([pa.array([feature], pa.int32()), pa.array([told])], names=["feature", "told"])

        found = packs.mapInArrow(add, shape)
        if many:
            told = {r["feature"]: r["told"] for r in found.groupBy("feature").applyInArrow(whole, "feature int, told string").collect()}
        else:
            parts: dict[int, np.ndarray] = {}
            for feature, sums in zip(*found.toArrow().to_pydict().values()):
                parts[feature] = parts.get(feature, 0.0) + np.asarray(sums)
            told = {f: json.dumps(s.tolist()) if f < 0 else split(f, s) for f, s in parts.items()}
        squares, held = json.loads(told.pop(-1))
        read = {f: json.loads(t) for f, t in told.items()}
        gradient, rows = next(iter(read.values()))["whole"]
        splits = {f: {int(k): v for k, v in r["splits"].items()} for f, r in read.items()}
        return {"splits": splits, "gradient": gradient, "rows": rows}, squares / held if held else math.nan

    def _known(self) -> None:
        if self.base is None:
            raise RuntimeError("fit or load a model first")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add column ``p``."""
        self._known()
        shipped(df.sparkSession)
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            cells = np.stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(base + sum((t.values(cells, False) for t in trees), np.zeros(cells.shape[1])))

        return df.withColumn("p", predicted(*[F.col(f"`{c}`").cast("double") for c in self.features]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table, one row per node; leaves have no feature."""
        self._known()
        rows = [(k, i, t.depth[i], self.features[t.feature[i]] if t.feature[i] >= 0 else None, t.threshold[i] if t.feature[i] >= 0 else None,
                 t.gain[i], float(t.cover[i]), t.left[i] if t.feature[i] >= 0 else None, t.right[i] if t.feature[i] >= 0 else None, t.value[i])
                for k, t in enumerate(self.trees) for i in range(len(t.feature))]
        return spark.createDataFrame(rows, NODE)

    def importance(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        """``feature, importance, share``, largest first: mean ``gain`` or ``cover`` (train rows) of a feature's splits, their number
        (``weight``), or ``total_gain`` and ``total_cover``; 0 where unused."""
        wanted = {"weight": F.count("node").cast("double"), "gain": F.avg("gain"), "cover": F.avg("cover"),
                  "total_gain": F.sum("gain"), "total_cover": F.sum("cover")}
        if kind not in wanted:
            raise ValueError(f"one of {sorted(wanted)} is needed")
        splits = self.nodes(spark).where("feature IS NOT NULL").groupBy("feature").agg(wanted[kind].alias("importance"))
        names = spark.createDataFrame([(c,) for c in self.features], "feature string")
        full = names.join(splits, "feature", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        total = full.agg(F.sum("importance")).scalar()
        return full.withColumn("share", F.when(total > 0, F.col("importance") / total).otherwise(0.0)).orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and settings as two tables."""
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        told = json.dumps({"features": list(self.features), "target": self.target, "params": dict(self.params), "base": self.base,
                           "history": self.history, "trees": len(self.trees)})
        spark.createDataFrame([(told,)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeForecaster":
        told = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
        place = {c: i for i, c in enumerate(told["features"])}
        trees = [Tree() for _ in range(told["trees"])]
        for r in spark.read.schema(NODE).parquet(f"{path}/nodes").orderBy("tree", "node").toLocalIterator():
            tree = trees[r["tree"]]
            node = tree.add(r["value"], r["cover"], r["depth"])
            tree.gain[node] = r["gain"]
            if r["feature"] is not None:
                tree.feature[node], tree.threshold[node], tree.left[node], tree.right[node] = place[r["feature"]], r["threshold"], r["left"], r["right"]
        return cls(told["features"], told["target"], told["params"], trees, told["base"], [tuple(h) for h in told["history"]])


def best_iteration(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """1-based iteration with the smallest error before ``patience`` rounds without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cross_validate(forecaster: TreeForecaster, df: DataFrame, folds: int = 5, *, keys: Sequence[str] = (), pos: str = "slot") -> DataFrame:
    """Keys, ``folds, cv_rmse_mean, cv_rmse_std``: mean and population deviation of the error over expanding-window folds.

    One fit per fold on a range of row ordinals, shared by all series; errors are those of each series' own test rows.
    """
    if not keys and df.groupBy(pos).count().where("count > 1").limit(1).count():
        raise ValueError(f"several rows share a {pos!r}: name their keys")
    placed = materialise(with_ordinal(df, keys, pos))
    size = F.floor(F.col("rows") / (folds + 1))
    errors = []
    for i in range(folds):
        start = F.col("rows") - (folds - i) * size
        fold = TreeForecaster(forecaster.features, forecaster.target, forecaster.params).fit(placed.where(F.col("ord") < start))
        test = placed.where((F.col("ord") >= start) & (F.col("ord") < start + size))
        e = F.col(forecaster.target) - F.col("p")
        errors.append(fold.predict(test).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse")))
    told = errors[0]
    for table in errors[1:]:
        told = told.unionByName(table)
    return told.groupBy(*keys).agg(F.lit(folds).alias("folds"), F.round(F.avg("rmse"), 4).alias("cv_rmse_mean"),
                                   F.round(F.stddev_pop("rmse"), 4).alias("cv_rmse_std"))
