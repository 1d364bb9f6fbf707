"""Seasonal autoregressive moving-average models of any order, for one series or many.

``(1 - ar(B)) (1 - sar(B^s)) (w - ...) = constant + (1 + ma(B)) (1 + sma(B^s)) e`` with ``w`` the series differenced
``d`` times and ``D`` times over the season. The weights minimise the sum of squared shocks given the first values
(Gauss-Newton with damping), from a two-stage regression as start.

Shocks are a recursion over the whole series. Chunks run it from nothing, each in its own task; the true state at a
chunk's start is an affine map of the state before, so a scan over one small row per chunk gives all starts, and a second
pass sums what a step needs. Series do not meet: every pass serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.plans.chunks import CHUNK
from gridtide.plans.packs import described, in_one_piece, packed, per_row, plain, series_of, shipped, totals, with_values
from gridtide.plans.recurrence import companion, state_of, unfolded
from gridtide.plans.slots import slot_time
from gridtide.session import materialise

TOLERANCE = 1e-6  # relative gain of a step below which the fit has settled


@dataclass(frozen=True)
class Order:
    """Orders of the model; ``season`` counts steps."""

    p: int = 1
    d: int = 1
    q: int = 1
    P: int = 1
    D: int = 1
    Q: int = 1
    season: int = 24
    constant: bool = False

    def __post_init__(self):
        if min(self.p, self.d, self.q, self.P, self.D, self.Q) < 0 or self.season < 1:
            raise ValueError("orders are not negative")
        if (self.P or self.D or self.Q) and self.season < 2:
            raise ValueError("a seasonal part needs a season of two steps or more")
        if (self.P and self.p >= self.season) or (self.Q and self.q >= self.season):
            raise ValueError("the orders reach into the season")

    @property
    def names(self) -> list[str]:
        seasonal = [f"ar.S{self.season * i}" for i in range(1, self.P + 1)], [f"ma.S{self.season * i}" for i in range(1, self.Q + 1)]
        return (["constant"] * self.constant + [f"ar.L{i}" for i in range(1, self.p + 1)] + seasonal[0]
                + [f"ma.L{i}" for i in range(1, self.q + 1)] + seasonal[1])

    @property
    def lost(self) -> int:
        """Values that differencing takes."""
        return self.d + self.D * self.season

    @property
    def ar_reach(self) -> int:
        return self.p + self.P * self.season

    @property
    def ma_reach(self) -> int:
        return self.q + self.Q * self.season

    @property
    def long_reach(self) -> int:
        """Order of the autoregression that estimates the first shocks: past all lags of the model."""
        return max(self.ar_reach, self.ma_reach, 1) + 1

    @property
    def before(self) -> int:
        """Values before a chunk that a pass reads."""
        return self.lost + self.long_reach + max(self.ar_reach, self.ma_reach)

    @property
    def least(self) -> int:
        return self.lost + 2 * self.long_reach + max(self.ar_reach, self.ma_reach) + 2 * (len(self.names) + 1)

    def parts(self, weights: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Constant and the four polynomials in the lag."""
        rest = list(weights)
        constant = rest.pop(0) if self.constant else 0.0
        out = []
        for n, step, sign in ((self.p, 1, -1), (self.P, self.season, -1), (self.q, 1, 1), (self.Q, self.season, 1)):
            poly = np.zeros(n * step + 1)
            poly[0] = 1
            poly[step::step] = [sign * rest.pop(0) for _ in range(n)]
            out.append(poly)
        return constant, *out

    def differences(self) -> np.ndarray:
        poly = np.ones(1)
        for n, step in ((self.d, 1), (self.D, self.season)):
            one = np.zeros(step + 1)
            one[0], one[-1] = 1, -1
            for _ in range(n):
                poly = np.convolve(poly, one)
        return poly


# ---------------------------------------------------------------- recursions

def _applied(poly: np.ndarray, values: np.ndarray, lag: int = 0) -> np.ndarray:
    """``poly(B) B^lag`` of a list, null (not a number) where the list does not reach back."""
    out = np.full(len(values), np.nan)
    reach = len(poly) - 1 + lag
    if len(values) > reach:
        out[reach:] = np.convolve(values, poly, "full")[len(poly) - 1:len(values) - lag]
    return out


def _inverse(poly: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` coefficients of ``1 / poly``, by doubling."""
    out = np.ones(1)
    while len(out) < n:
        m = min(2 * len(out), n)
        rest = -np.convolve(poly[:m], out)[:m]
        rest[0] += 2
        out = np.convolve(out, rest)[:m] if m < 64 else _product(out, rest)[:m]
    return out[:n]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials; rows of ``b`` each."""
    size = 1 << max(1, (a.shape[-1] + b.shape[-1] - 2).bit_length())
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[..., :a.shape[-1] + b.shape[-1] - 1]


class Recursion:
    """``out_t = in_t - sum ma_j out_(t-j)`` for rows of inputs of one length."""

    def __init__(self, ma: np.ndarray, n: int):
        self.ma, self.n, self.reach = ma, n, len(ma) - 1
        self.inverse = _inverse(ma, n) if self.reach else np.ones(1)

    def run(self, inputs: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Outputs after ``past`` outputs (rows of ``reach`` values, the latest last)."""
        if not self.reach:
            return inputs
        inputs = inputs.copy()
        m = min(self.reach, self.n)
        for k in range(len(inputs)):
            if past[k].any():
                inputs[k, :m] -= np.convolve(past[k], self.ma)[self.reach:self.reach + m]
        return _product(self.inverse, inputs)[:, :self.n]

    def end(self, past: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.concatenate([past, out], axis=1)[:, out.shape[1]:] if self.reach else past


def _derivative_inputs(order: Order, weights, shocks: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Inputs of the derivatives by the moving-average weights, rows of the length of ``shocks``."""
    _, _, _, ma, sma = order.parts(weights)
    whole = np.concatenate([past, shocks])
    rows = [(sma, j) for j in range(1, order.q + 1)] + [(ma, j * order.season) for j in range(1, order.Q + 1)]
    return np.array([-_applied(poly, whole, lag)[len(past):] for poly, lag in rows]).reshape(len(rows), len(shocks))


def run_chunk(order: Order, weights, w: np.ndarray, own: int, place: int, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shocks and their derivatives by all weights, state at the end) of a chunk.

    ``w`` holds the differenced values of the chunk, ``own`` at its end, and some before; ``place`` is the place of the first
    own one in the series. Shocks of the first ``ar_reach`` places are 0. ``past`` has a row of ``ma_reach`` values for the shocks
    and each derivative, in the order of the weights.
    """
    constant, ar, sar, ma, sma = order.parts(weights)
    rows = [_applied(np.convolve(ar, sar), w) - constant]
    rows += [np.full(len(w), -1.0)] * order.constant
    rows += [-_applied(sar, w, i) for i in range(1, order.p + 1)] + [-_applied(ar, w, i * order.season) for i in range(1, order.P + 1)]
    inputs = np.array(rows)[:, len(w) - own:]
    inputs[:, :max(0, min(own, order.ar_reach - place))] = 0
    recursion = Recursion(np.convolve(ma, sma), own)
    first = recursion.run(inputs, past[:len(rows)])
    later = recursion.run(_derivative_inputs(order, weights, first[0], past[0]), past[len(rows):])
    out = np.concatenate([first, later])
    return out, recursion.end(past, out)


def transition(order: Order, weights, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How a state passes ``n`` steps without inputs: own part of any row, and what the shocks' row adds to the last rows."""
    _, _, _, ma, sma = order.parts(weights)
    recursion, m = Recursion(np.convolve(ma, sma), n), order.ma_reach
    unit = np.eye(m)
    out = recursion.run(np.zeros((m, n)), unit)
    own = recursion.end(unit, out)
    added = np.zeros((order.q + order.Q, m, m))
    for i in range(m):
        rows = _derivative_inputs(order, weights, out[i], unit[i])
        none = np.zeros((len(rows), m))
        added[:, i] = recursion.end(none, recursion.run(rows, none))
    return own, added


def invertible(order: Order, weights) -> bool:
    """Whether the moving-average part forgets its past."""
    for poly in order.parts(weights)[3:]:
        significant = np.trim_zeros(poly, "b")
        if len(significant) > 1 and np.abs(np.roots(significant)).max() >= 0.9999:
            return False
    return True


# ---------------------------------------------------------------- passes

def _differenced(order: Order, row: dict) -> tuple[np.ndarray, int, int]:
    """(differenced values of the chunk and before, own ones, place of the first own one); of the first chunk only what exists."""
    w = _applied(order.differences(), row["values"])[order.lost:]
    place = row["first"] - row["start"] - order.lost
    own = row["n"] + min(0, place)
    return w, max(0, min(own, len(w))), max(0, place)


def _lags(values: np.ndarray, at: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    return np.stack([values[at - k] for k in lags], axis=1) if len(lags) else np.zeros((len(at), 0))


def _cross(x: np.ndarray) -> np.ndarray:
    return (x.T @ x).ravel()


def _long_products(order: Order, row: dict) -> np.ndarray:
    """Products of 1, the lags of the long autoregression and the value."""
    w, own, place = _differenced(order, row)
    k = order.long_reach
    at = np.arange(len(w) - own + max(0, k - place), len(w))
    return _cross(np.column_stack([np.ones(len(at)), _lags(w, at, range(1, k + 1)), w[at]]))


def _start_products(order: Order, row: dict) -> np.ndarray:
    """Products of 1, the model's lags of values and of first shocks, and the value."""
    w, own, place = _differenced(order, row)
    k = order.long_reach
    long = np.asarray(row["long"])
    poly = np.concatenate([[1.0], -long[1:]])
    shocks = _applied(poly, w) - long[0]
    most = max(order.ar_reach, order.ma_reach)
    at = np.arange(len(w) - own + max(0, k + most - place), len(w))
    ar = [*range(1, order.p + 1), *[order.season * i for i in range(1, order.P + 1)]]
    ma = [*range(1, order.q + 1), *[order.season * i for i in range(1, order.Q + 1)]]
    return _cross(np.column_stack([np.ones(len(at)), _lags(w, at, ar), _lags(shocks, at, ma), w[at]]))


def _solved(products: np.ndarray, drop: Sequence[int] = ()) -> np.ndarray:
    """Weights of all columns but the last on the last; collinear ones get the smallest weights."""
    n = math.isqrt(len(products))
    matrix = np.asarray(products).reshape(n, n)
    inputs = [i for i in range(n - 1) if i not in drop]
    scale = np.sqrt(np.maximum(np.diag(matrix)[inputs], 1e-300))
    weights = np.linalg.lstsq(matrix[np.ix_(inputs, inputs)] / np.outer(scale, scale), matrix[inputs, -1] / scale, rcond=1e-12)[0] / scale
    return weights


def _first_weights(order: Order, products: np.ndarray) -> np.ndarray:
    """The two-stage weights, the moving-average ones drawn in until the part is invertible."""
    found = _solved(products, () if order.constant else (0,))
    ma = slice(order.constant + order.p + order.P, None)
    while not invertible(order, found):
        found[ma] *= 0.8
    return found


def _states(order: Order):
    """True states at the starts of a series' chunks, from the ends of the chunks run from nothing."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(({"at": i, **plain({c: table.column(c)[i] for c in ("_chunk", "own", "end", "trial")})} for i in range(table.num_rows)),
                      key=lambda r: r["_chunk"])
        m, known = order.ma_reach, {}
        state, starts = np.zeros((1 + len(order.names), m)), []
        last = order.q + order.Q
        for r in rows:
            starts.append(state.ravel())
            if not m or not r["own"]:
                continue
            if r["own"] not in known:
                known[r["own"]] = transition(order, r["trial"], r["own"])
            own, added = known[r["own"]]
            after = state @ own
            if last:
                after[-last:] += np.einsum("i,kij->kj", state[0], added)
            state = after + np.reshape(r["end"], state.shape)
        at = pa.array([r["at"] for r in rows], pa.int64())
        listed = pa.array(starts, pa.list_(pa.float64()))
        return pa.table([table.column("_series").combine_chunks().take(at), pa.array([r["_chunk"] for r in rows]), listed],
                        names=["_series", "_chunk", "state"])
    return run


def _chunk_shocks(order: Order, row: dict, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    w, own, place = _differenced(order, row)
    past = np.zeros((1 + len(order.names), order.ma_reach)) if state is None else np.reshape(state, (1 + len(order.names), order.ma_reach))
    if not own:
        return np.zeros((1 + len(order.names), 0)), past, place
    out, end = run_chunk(order, row["trial"], w, own, place, past)
    return out, end, place


def _ends(order: Order):
    def end(row: dict) -> dict:
        out, after, _ = _chunk_shocks(order, row, None)
        return {"_chunk": row["_chunk"], "own": out.shape[1], "end": after.ravel(), "trial": row["trial"]}
    return end


def _step_products(order: Order):
    """Products of the derivatives and the shocks."""
    def products(row: dict) -> np.ndarray:
        out, _, place = _chunk_shocks(order, row, row["state"])
        counted = out[:, max(0, min(out.shape[1], order.ar_reach - place)):]
        return np.append(_cross(np.concatenate([counted[1:], counted[:1]]).T), counted.shape[1])
    return products


def _with_states(order: Order, rows: DataFrame) -> DataFrame:
    """Packed rows with ``trial`` weights and the ``state`` at their start."""
    shipped(rows.sparkSession)
    ends = per_row(rows.select("_series", "_chunk", "n", "first", "start", "values", "trial"), _ends(order),
                   "_chunk long, own long, end array<double>, trial array<double>")
    shape = f"_series {rows.schema['_series'].dataType.simpleString()}, _chunk long, state array<double>"
    starts = ends.groupBy("_series").applyInArrow(_states(order), shape)
    return rows.join(starts.withColumnsRenamed({"_series": "_s", "_chunk": "_c"}), (F.col("_s") == F.col("_series")) & (F.col("_c") == F.col("_chunk"))).drop("_s", "_c")


_FIT = ("weights array<double>, squares double, products array<double>, counted double, trial array<double>, damping double, "
        "start_squares double, steps int, settled boolean")


def _taken(order: Order):
    """A series' fit after the sums of its trial weights are known: keep them if better, and the next trial."""
    k = len(order.names)

    def step(row: dict) -> dict:
        total = row["total"]
        products, counted = total[:-1].reshape(k + 1, k + 1), float(total[-1])
        squares, first = float(products[-1, -1]), row["weights"] is None
        fit = {c: row[c] for c in ("weights", "squares", "products", "counted", "damping", "start_squares", "steps", "settled")}
        better = first or (math.isfinite(squares) and squares <= fit["squares"])
        settled = bool(k == 0 or (not first and better and fit["squares"] - squares <= TOLERANCE * fit["squares"]))
        if better:
            fit |= {"weights": row["trial"], "squares": squares, "products": products.ravel(), "counted": counted,
                    "damping": 1e-9 if first else max(fit["damping"] / 10, 1e-9)}
        else:
            fit["damping"] = max(10 * fit["damping"], 1e-3)
        if first:
            fit |= {"start_squares": squares, "steps": 0}
        fit["steps"] += 1
        held = np.reshape(fit["products"], (k + 1, k + 1))
        slope, bend = held[:k, k], held[:k, :k]
        trial = np.asarray(fit["weights"], float)
        while k and not settled:
            if fit["damping"] > 1e8:
                settled = True
                break
            move = np.linalg.lstsq(bend + fit["damping"] * np.diag(np.maximum(np.diag(bend), 1e-12)), -slope, rcond=None)[0]
            trial = np.asarray(fit["weights"], float) + move
            if np.isfinite(trial).all() and invertible(order, trial):
                break
            fit["damping"] = max(10 * fit["damping"], 1e-3)
        return fit | {"trial": trial, "settled": settled}
    return step


SAVED = ("orders", "constant", "value", "weights", "rows", "end", "counted", "squares", "start_squares", "steps", "status", "recent", "shocks")


@dataclass
class SeasonalForecaster:
    """A seasonal model per series; ``fits`` is a written table with one row per series."""

    value: str
    order: Order = field(default_factory=Order)
    keys: Sequence[str] = ()
    pos: str = "slot"
    max_steps: int = 20
    chunk: int = CHUNK
    fits: DataFrame | None = None

    def _packs(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        packs = materialise(packed(df, self.value, self.keys, self.pos, self.order.before, self.chunk), "packs")
        return packs, materialise(described(packs, self.order.least), "series")

    def _rows(self, packs: DataFrame, stats: DataFrame) -> DataFrame:
        fine = stats.where("status IS NULL").select("_series", "start")
        return materialise(packs.select("_series", "_chunk", "n", "first", "last", "values").join(fine, "_series"), "rows")

    def fit(self, df: DataFrame, weights: Sequence[float] | None = None) -> "SeasonalForecaster":
        """Fit every series on a dense grid without nulls; ``weights`` (in the order of ``order.names``) are taken as they are.

        A series with gaps, nulls, repeated positions or too few rows is an error, and with keys a row with the reason as
        its status and no forecasts.
        """
        order, spark = self.order, df.sparkSession
        packs, stats = self._packs(df)
        in_one_piece(stats, self.keys)
        rows = self._rows(packs, stats)
        if weights is None:
            long = totals(rows, lambda r: _long_products(order, r))
            long = materialise(per_row(long, lambda r: {"long": _solved(r["total"])}, "long array<double>"), "long")
            first = totals(rows.join(long, "_series"), lambda r: _start_products(order, r))
            first = per_row(first, lambda r: {"trial": _first_weights(order, r["total"])}, "trial array<double>")
        else:
            if len(weights) != len(order.names):
                raise ValueError(f"weights for {order.names} are needed")
            first = rows.select("_series").distinct().withColumn("trial", F.array(*[F.lit(float(x)) for x in weights]).cast("array<double>"))
        empty = {name: F.lit(None).cast(kind) for name, kind in (part.split(" ") for part in _FIT.split(", ")) if name != "trial"}
        fits = materialise(first.withColumns(empty), "fit")
        done = []
        for _ in range(1 if weights is not None else self.max_steps):
            tried = _with_states(order, rows.join(fits.select("_series", "trial"), "_series"))
            sums = totals(tried, _step_products(order))
            fits = materialise(per_row(fits.join(sums, "_series"), _taken(order), _FIT), "fit")
            done.append(fits.where("settled"))
            fits = fits.where("not settled")
            if fits.isEmpty():
                break
        known = fits
        for table in done:
            known = known.unionByName(table)
        known = materialise(known, "fits")
        self.fits = materialise(self._told(rows, stats, known), "models")
        return self

    def _told(self, rows: DataFrame, stats: DataFrame, known: DataFrame) -> DataFrame:
        """Fits with what forecasts need: the last values and shocks."""
        order = self.order
        wanted = max(order.ar_reach + order.lost, 1)

        def late(row: dict) -> dict:
            out, end, _ = _chunk_shocks(order, row, row["state"])
            return {"recent": row["values"][-wanted:], "shocks": end[0]}

        tried = _with_states(order, rows.join(known.select("_series", F.col("weights").alias("trial")), "_series"))
        ends = stats.select(F.col("_series").alias("_s"), F.col("end").alias("_e"))
        tails = tried.join(ends, (F.col("_s") == F.col("_series")) & (F.col("_e") == F.col("last")))
        recent = per_row(tails.drop("_s", "_e"), late, "recent array<double>, shocks array<double>")
        told = stats.select("_series", "rows", "end", "status").join(
            known.select("_series", "weights", "squares", "start_squares", "counted", "steps"), "_series", "left").join(recent, "_series", "left")
        orders = F.array(*[F.lit(v) for v in (order.p, order.d, order.q, order.P, order.D, order.Q, order.season)])
        return told.select(*[F.col(f"_series.`{k}`") for k in self.keys], orders.alias("orders"), F.lit(order.constant).alias("constant"), F.lit(self.value).alias("value"), "weights", "rows", "end",
                           "counted", "squares", "start_squares", "steps", F.coalesce("status", F.lit("ok")).alias("status"), "recent", "shocks")

    def _fitted(self) -> DataFrame:
        if self.fits is None:
            raise RuntimeError("fit or load a model first")
        return self.fits

    def summary(self) -> DataFrame:
        """Keys, ``name``, ``value``: weights, then ``n``, ``sigma2``, ``log_likelihood``, ``aic``, ``bic``; long form."""
        k = len(self.order.names)
        sigma2, n = F.col("squares") / F.col("counted"), F.col("counted")
        likelihood = -n / 2 * (F.lit(math.log(2 * math.pi)) + F.log(sigma2) + 1)
        wide = self._fitted().where("status = 'ok'").withColumns({
            "n": n, "sigma2": sigma2, "log_likelihood": likelihood, "aic": -2 * likelihood + 2 * (k + 1), "bic": -2 * likelihood + (k + 1) * F.log(n)})
        pairs = [F.struct(F.lit(name).alias("name"), F.get("weights", i).alias("value")) for i, name in enumerate(self.order.names)]
        pairs += [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("n", "sigma2", "log_likelihood", "aic", "bic", "start_squares", "squares")]
        return wide.select(*self.keys, F.explode(F.array(*pairs)).alias("e")).select(*self.keys, "e.name", "e.value")

    def shocks(self, df: DataFrame) -> DataFrame:
        """Keys, position, ``shock`` of every row that has one, with the weights of the fit."""
        order = self.order
        packs, stats = self._packs(df)
        rows = self._rows(packs, stats)
        models = self._fitted().where("weights IS NOT NULL").select(series_of(self.keys).alias("_series"), F.col("weights").alias("trial"))
        tried = _with_states(order, rows.join(models, "_series"))

        def unfold(row: dict) -> list[dict]:
            out, _, place = _chunk_shocks(order, row, row["state"])
            begin = row["last"] - out.shape[1] + 1
            return [{"at": begin + i, "shock": float(e)} for i, e in enumerate(out[0]) if place + i >= order.ar_reach]

        found = per_row(tried, unfold, "at long, shock double")
        return found.select(*[F.col(f"_series.`{k}`") for k in self.keys], F.col("at").alias(self.pos), "shock")

    def fitted(self, df: DataFrame) -> DataFrame:
        """``df`` with one-step values ``p``; null for the first rows."""
        wide = with_values(df, self.shocks(df), self.keys, self.pos, "shock")
        return wide.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(self.value) - F.col("shock")).alias("p"))

    def forecast(self, steps: int = 24, *, freq: str = "H") -> DataFrame:
        """Keys, ``step``, ``ts``, ``p``: ``steps`` values ahead of each series.

        Without further shocks the values follow a linear recurrence, which blocks of steps unfold as rows of their own.
        """
        order = self.order
        models = self._fitted().where("weights IS NOT NULL").select(series_of(self.keys).alias("_series"), "weights", "recent", "shocks", "end")

        def make(row: dict):
            constant, ar, sar, ma, sma = order.parts(row["weights"])
            values = -np.convolve(np.convolve(ar, sar), order.differences())[1:]
            return companion(values, np.convolve(ma, sma)[1:], constant), state_of(row["recent"], row["shocks"], max(len(values), 1))

        found = unfolded(models, steps, make)
        return found.select(*[F.col(f"_series.`{k}`") for k in self.keys], "step", slot_time("slot", freq).alias("ts"), "p")

    def save(self, path: str) -> None:
        """The fits as a table: one row per series."""
        self._fitted().write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SeasonalForecaster":
        fits = spark.read.parquet(path)
        first = fits.select("orders", "constant", "value").first()
        if first is None:
            raise ValueError("no model is saved there")
        return cls(first["value"], Order(*first["orders"], first["constant"]), [c for c in fits.columns if c not in SAVED], fits=fits)
