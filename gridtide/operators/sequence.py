"""Next value from the last values, a robust linear model, for one series or many.

The mean Huber loss plus a little ridge is minimised by Newton steps; where one does not gain, the bend is mixed with
that of reweighted least squares, whose step always does. One pass over the chunks sums the products for both, and the
losses of the weights so far on the train and the validation windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.plans.chunks import CHUNK
from gridtide.plans.packs import described, in_one_piece, packed, per_row, series_of, totals, with_values
from gridtide.plans.recurrence import companion, state_of, unfolded
from gridtide.plans.slots import slot_time
from gridtide.session import materialise

SETTLED = 1e-9  # relative gain of a step, below which the fit has settled


def windows(row: dict, look_back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(1 and the values before, latest first; values; places in the series' windows) of a chunk's own rows."""
    y, own = row["values"], row["n"]
    at = np.arange(max(len(y) - own, look_back), len(y))
    x = np.stack([np.ones(len(at)), *[y[at - k] for k in range(1, look_back + 1)]], axis=1)
    return x, y[at], at - (len(y) - own) + row["first"] - row["start"] - look_back


def losses(error: np.ndarray, delta: float) -> np.ndarray:
    size = np.abs(error)
    return np.where(size <= delta, 0.5 * error**2, delta * (size - 0.5 * delta))


def _sums(look_back: int, delta: float, validation: float):
    """Weighted products, gradient and losses at the weights so far; windows from the cut on are for validation."""
    def kernel(row: dict) -> np.ndarray:
        x, y, place = windows(row, look_back)
        cut = int((row["rows"] - look_back) * (1 - validation))
        error = y - x @ row["weights"]
        train = place < cut
        told = []
        for part in (train, ~train):
            told += [part.sum(), losses(error[part], delta).sum(), np.abs(error[part]).sum()]
        x, y, error = x[train], y[train], error[train]
        calm = delta / np.maximum(np.abs(error), delta)
        gradient = -(x * (calm * error)[:, None]).sum(axis=0)
        inner = x[np.abs(error) <= delta]
        return np.concatenate([told, gradient, (inner.T @ inner).ravel(), (x.T @ (x * calm[:, None])).ravel()])
    return kernel


def _next(look_back: int, ridge: float):
    """The step that the sums give, with the losses of the weights before it."""
    k = look_back + 1

    def step(row: dict) -> dict:
        total, weights = row["total"], row["weights"]
        n, loss, mae, m, later, later_mae = total[:6]
        penalty = np.full(k, ridge * n)
        penalty[0] = 0
        gradient = total[6:6 + k] + penalty * weights
        bends = total[6 + k:].reshape(2, k, k) + np.diag(penalty)
        target = loss / n + 0.5 * ridge * float(weights[1:] @ weights[1:])
        told = {"iteration": row["iteration"] + 1, "loss": loss / n, "mae": mae / n, "val_loss": later / m if m else None,
                "val_mae": later_mae / m if m else None, "gradient": float(np.abs(gradient).max()) / n}
        worse = row["objective"] is not None and target > row["objective"]
        if worse:  # again from the best weights, more carefully
            settled, target, weights, held = row["mix"] >= 1, row["objective"], row["best"], row["held"]
            mix = min(1.0, max(4 * row["mix"], 0.25))
        else:
            settled = row["objective"] is not None and row["objective"] - target <= SETTLED * target
            held, mix = np.concatenate([gradient, bends.ravel()]), row["mix"] / 4
        newton, sure = held[k:].reshape(2, k, k)
        move = np.linalg.lstsq((1 - mix) * newton + mix * sure, held[:k], rcond=1e-13)[0]
        return told | {"weights": weights - move, "objective": target, "best": weights, "held": held, "mix": mix, "settled": settled}
    return step


_STEP = ("iteration int, weights array<double>, objective double, best array<double>, held array<double>, mix double, loss double, mae double, val_loss double, "
         "val_mae double, gradient double, settled boolean")


@dataclass
class SequenceForecaster:
    """A model per series; ``fits`` (a row per series) and ``steps`` (a row per iteration) are written tables."""

    value: str
    look_back: int = 24
    keys: Sequence[str] = ()
    pos: str = "slot"
    delta: float = 0.1
    ridge: float = 1e-4
    max_steps: int = 30
    chunk: int = CHUNK
    fits: DataFrame | None = None
    steps: DataFrame | None = None

    def _rows(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        packs = materialise(packed(df, self.value, self.keys, self.pos, self.look_back, self.chunk), "packs")
        stats = materialise(described(packs, self.look_back + 2), "series")
        in_one_piece(stats, self.keys)
        fine = stats.where("status IS NULL").select("_series", "start", "end", "rows")
        return packs.select("_series", "_chunk", "n", "first", "last", "values").join(fine, "_series"), stats

    def fit(self, df: DataFrame, validation: float = 0.1) -> "SequenceForecaster":
        """Fit every series on a dense grid without nulls; the last share of the windows, ``validation``, only measures losses.

        Values should be scaled to about 1, as ``delta`` is where the loss turns linear. A series that cannot be fitted is an
        error, and with keys a row with the reason as its status.
        """
        rows, stats = self._rows(df)
        rows = materialise(rows, "rows")
        now = materialise(rows.select("_series").distinct(), "now").select(
            "_series", F.lit(0).alias("iteration"), F.array_repeat(F.lit(0.0), self.look_back + 1).alias("weights"),
            F.lit(None).cast("double").alias("objective"), *[F.lit(None).cast("array<double>").alias(c) for c in ("best", "held")], F.lit(4.0).alias("mix"))
        kernel, step = _sums(self.look_back, self.delta, validation), _next(self.look_back, self.ridge)
        told, done = [], []
        for _ in range(self.max_steps):
            sums = totals(rows.join(now.select("_series", "weights"), "_series"), kernel)
            moved = materialise(per_row(now.join(sums, "_series"), step, _STEP), "step")
            told.append(moved)
            done.append(moved.where("settled"))
            now = moved.where("not settled").select("_series", "iteration", "weights", "objective", "best", "held", "mix")
            if now.isEmpty():
                break
        else:
            done.append(told[-1].where("not settled"))
        history, known = told[0], done[0]
        for table in told[1:]:
            history = history.unionByName(table)
        for table in done[1:]:
            known = known.unionByName(table)
        key = [F.col(f"_series.`{k}`") for k in self.keys]
        self.steps = history.select(*key, F.col("iteration") - 1, "loss", "val_loss", "mae", "val_mae", "gradient").toDF(
            *self.keys, "iteration", "loss", "val_loss", "mae", "val_mae", "gradient")
        fits = stats.select("_series", "rows", F.coalesce("status", F.lit("ok")).alias("status")).join(
            known.select("_series", F.col("best").alias("weights")), "_series", "left")
        self.fits = materialise(fits.select(*key, F.lit(self.value).alias("value"), F.lit(self.look_back).alias("look_back"), "weights", "rows", "status"), "models")
        return self

    def _models(self) -> DataFrame:
        if self.fits is None:
            raise RuntimeError("fit or load a model first")
        return self.fits.where("weights IS NOT NULL").select(series_of(self.keys).alias("_series"), "weights")

    def history(self) -> DataFrame:
        """Keys, ``iteration, loss, val_loss, mae, val_mae, gradient``; iteration 0 is the model that is always 0."""
        if self.steps is None:
            raise RuntimeError("fit a model first; a loaded one has no history")
        return self.steps

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with one-step values ``p``; null for the first ``look_back`` rows of a series."""
        models, look_back = self._models(), self.look_back

        def unfold(row: dict) -> list[dict]:
            x, _, place = windows(row, look_back)
            return [{"at": row["start"] + look_back + int(i), "p": float(p)} for i, p in zip(place, x @ row["weights"])]

        found = per_row(self._rows(df)[0].join(models, "_series"), unfold, "at long, p double")
        found = found.select(*[F.col(f"_series.`{k}`") for k in self.keys], F.col("at").alias(self.pos), "p")
        return with_values(df, found, self.keys, self.pos, "p")

    def multi_step(self, df: DataFrame, steps: int = 24, *, freq: str = "H") -> DataFrame:
        """Keys, ``step``, ``ts``, ``p``: predictions fed back ``steps`` times after the last row of each series."""
        look_back = self.look_back
        rows = self._rows(df)[0].where("last = end").join(self._models(), "_series")

        def make(row: dict):
            weights = row["weights"]
            return companion(weights[1:], np.zeros(0), float(weights[0])), state_of(row["values"], np.zeros(0), look_back)

        found = unfolded(rows, steps, make)
        return found.select(*[F.col(f"_series.`{k}`") for k in self.keys], "step", slot_time("slot", freq).alias("ts"), "p")

    def save(self, path: str) -> None:
        """The fits as a table: one row per series."""
        self._models()
        self.fits.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SequenceForecaster":
        fits = spark.read.parquet(path)
        first = fits.select("value", "look_back").first()
        if first is None:
            raise ValueError("no model is saved there")
        own = ("value", "look_back", "weights", "rows", "status")
        return cls(first["value"], first["look_back"], [c for c in fits.columns if c not in own], fits=fits)
