"""Document quality by pairwise ranking (Bradley-Terry): which of two documents is preferred.

A document's score is a weighted sum of surface features; the chance that one is preferred to another is
the logistic function of the difference of their scores. Weights come from preference pairs (a document
labelled good over one labelled bad), so only differences of features count. The cut between good and
bad is the place among the learning scores that parts the labels best.

Every labelled document is learned, in pairs with all documents of the other label. Pairs are not listed: the chance of a
pair is a power series in the distances of both scores from the middles of their bins, so the sums over all pairs follow from
sums per bin of scores. A Newton step is one pass over the features, whose result has a size that does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import LOWER, Words, rolling_hashes, slices, tidy, with_columns
from gridtide.session import materialise

FEW_LABELS = 200_000  # up to so many labels are sent to the texts, else the features of all texts meet them in a join
STEP = 1 / 8          # width of a bin of scores
ORDERS = 8            # terms of a pair's series; the rest is below 1e-11 of the pair
STEPS = 100           # Newton steps at most; the loss is strictly convex, about ten are usual
CUT = 0.3             # score at the cut between good and bad
FEATURES = ("upper", "symbols", "pipes", "exclaims", "same_as_before", "distinct", "top_word", "same_lines", "word_length",
            "digits", "log_words", "stops", "commas", "beyond_ascii", "repeated_runs", "letters", "line_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_KINDS = np.stack([_UPPER, _LETTER, _SYMBOL, np.arange(256) == 124, np.arange(256) == 33, np.isin(np.arange(256), np.arange(48, 58)),
                   np.isin(np.arange(256), [46, 63]), np.arange(256) == 44, np.arange(256) >= 128, np.arange(256) == 10])


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, from the whole text; zeros for a text without words."""
    out = np.zeros((len(column), len(FEATURES)))
    for lo, _, data, offsets in slices(column):
        words = Words(LOWER[data], offsets)
        hashes = words.hashes()
        for i in range(len(offsets) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            n = b - a
            if not n:
                continue
            own = data[offsets[i]:offsets[i + 1]]
            times = np.bincount(own, minlength=256)
            upper, letters, symbols, pipes, exclaims, digits, stops, commas, beyond, breaks = (_KINDS @ times).tolist()
            mine = hashes[a:b]
            _, counts = np.unique(mine, return_counts=True)
            runs = rolling_hashes(mine, 3)
            _, run_counts = np.unique(runs, return_counts=True)
            size = int((words.end[a:b] - words.start[a:b]).sum())
            lines = bytes(own).split(b"\n") if breaks else []
            lines = [x for x in lines if x.strip()]
            out[lo + i] = (upper / max(letters, 1), symbols / n, pipes / n, exclaims / n, (mine[1:] == mine[:-1]).sum() / n,
                           len(counts) / n, counts.max() / n if n > 9 else 0.1, 1 - len(set(lines)) / len(lines) if lines else 0,
                           size / n, digits / size, np.log1p(n), stops / n, commas / n, beyond / size,
                           (run_counts[run_counts > 1]).sum() / max(len(runs), 1), letters / size, np.log1p(n / (breaks + 1)))
    return out


@dataclass
class QualityRanking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def scaled(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -6, 6)

    def raw(self, features: np.ndarray) -> np.ndarray:
        return (self.scaled(features) * self.weights).sum(axis=1)  # row by row: equal features score equally in any batch

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` at the cut."""
        above = self.raw(features) - self.cut + np.log(CUT / (1 - CUT))
        return np.where(above == np.log(CUT / (1 - CUT)), CUT, 1 / (1 + np.exp(-np.clip(above, -500, 500))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bin_sums(ranking: QualityRanking):
    """Per label and bin of scores: sums of the powers of the distance to the bin's middle, of features times these powers, of
    products of two features. ``bin`` is twice the bin's number, plus 1 for good rows."""
    schema = pa.schema([("bin", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in (batch.slice(lo, 2048) for batch in batches for lo in range(0, batch.num_rows, 2048)):
            x = ranking.scaled(_matrix(part.column("features")))
            score = (x * ranking.weights).sum(axis=1)
            place = np.floor(score / STEP)
            bins = 2 * place.astype(np.int64) + part.column("good").to_numpy(zero_copy_only=False)
            order = np.argsort(bins, kind="stable")
            bins, x = bins[order], x[order]
            powers = (score - (place + 0.5) * STEP)[order, None] ** np.arange(ORDERS)
            one, other = np.triu_indices(x.shape[1])
            numbers = np.concatenate([powers, (powers[:, :, None] * x[:, None, :]).reshape(len(x), -1), x[:, one] * x[:, other]], axis=1)
            first = np.flatnonzero(np.diff(bins, prepend=bins[0] - 1))
            for at, sums in zip(bins[first].tolist(), np.add.reduceat(numbers, first, axis=0)):
                held[at] = held.get(at, 0.0) + sums
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], schema=schema)
    return run


def _added(table: pa.Table) -> pa.Table:
    sums = _matrix(table.column("sums").combine_chunks()).sum(axis=0)
    return pa.table({"bin": table.column("bin").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})


@dataclass
class _Bins:
    """The occupied bins of one label."""

    middle: np.ndarray   # scores
    powers: np.ndarray   # (bins, orders)
    firsts: np.ndarray   # (bins, orders, features)
    seconds: np.ndarray  # (bins, products)

    @classmethod
    def of(cls, bins: np.ndarray, sums: np.ndarray, width: int) -> _Bins:
        order = np.argsort(bins)
        sums, edge = sums[order], ORDERS * (width + 1)
        return cls((bins[order] + 0.5) * STEP, sums[:, :ORDERS], sums[:, ORDERS:edge].reshape(-1, ORDERS, width), sums[:, edge:])


def _logistic_series(x: np.ndarray) -> list[np.ndarray]:
    """The logistic function at ``x`` and its derivatives, each over the factorial of its order."""
    low = 1 / (1 + np.exp(np.minimum(np.abs(x), 700)))  # at -|x|: there all orders are small and exact
    out = [np.where(x <= 0, low, 1 - low)]
    term = np.polynomial.Polynomial([0, 1])
    for k in range(1, ORDERS):
        term = term.deriv() * np.polynomial.Polynomial([0, 1, -1])
        value = term(low) / factorial(k)
        out.append(value if k % 2 else np.where(x <= 0, value, -value))
    return out


def _pull(of: _Bins, other: _Bins) -> tuple[np.ndarray, np.ndarray]:
    """Per bin of ``of``, with s a row's score and d its distance from the middle: the series in d of the sum over ``other``'s rows
    of logistic(s - their score), and the sum of their features times its slope at the middles."""
    series = np.zeros((len(of.middle), ORDERS))
    drawn = np.zeros((len(of.middle), other.firsts.shape[2]))
    for lo in range(0, len(series), 256):
        kernel = _logistic_series(of.middle[lo:lo + 256, None] - other.middle)
        for k in range(ORDERS):
            for m in range(k + 1):
                series[lo:lo + 256, m] += comb(k, m) * (-1) ** (k - m) * (kernel[k] @ other.powers[:, k - m])
        drawn[lo:lo + 256] = kernel[1] @ other.firsts[:, 0]
    return series, drawn


def _slopes(rows: DataFrame, ranking: QualityRanking, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, and nearly the second derivatives, of the mean logistic loss over all pairs of a good and a bad row."""
    shape = "bin long, sums array<double>"
    found = rows.mapInArrow(tidy(_bin_sums(ranking)), shape).groupBy("bin").applyInArrow(_added, shape).toArrow()
    bins, sums = found.column("bin").to_numpy(), _matrix(found.column("sums").combine_chunks())
    width = len(ranking.weights)
    good, bad = (_Bins.of(bins[bins & 1 == v] >> 1, sums[bins & 1 == v], width) for v in (1, 0))
    pairs = good.powers[:, 0].sum() * bad.powers[:, 0].sum()
    up, _ = _pull(good, bad)
    down, drawn = _pull(bad, good)
    gradient = (np.tensordot(up, good.firsts, 2) + np.tensordot(down, bad.firsts, 2)) / pairs - good.firsts[:, 0].sum(axis=0) / good.powers[:, 0].sum()
    one, other = np.triu_indices(width)
    bend = np.zeros((width, width))
    bend[one, other] = bend[other, one] = up[:, 1] @ good.seconds + down[:, 1] @ bad.seconds
    crossed = bad.firsts[:, 0].T @ drawn
    return gradient + ridge * ranking.weights, (bend - crossed - crossed.T) / pairs + ridge * np.eye(width)


def _raw_rows(ranking: QualityRanking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ranking.raw(_matrix(batch.column("features"))) + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(raw, pa.float64())], names=["good", "raw"])
    return run


def _best_cut(rows: DataFrame, ranking: QualityRanking, good: int, bad: int) -> float:
    """Between the two neighbouring scores of all rows that part the labels best; the lowest score if no place parts them."""
    scores = rows.mapInArrow(tidy(_raw_rows(ranking)), "good boolean, raw double").groupBy("raw").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    scores = materialise(scores.repartitionByRange("raw").withColumn("part", F.spark_partition_id()), "quality-scores")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of scores
    before = scores.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select(
        "part", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(c) for c in ("g", "b")])
    inside = Window.partitionBy("part").orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)
    gain = (F.col("b") + F.sum("bad").over(inside)) * F.lit(good).cast("decimal(19,0)") - (
        F.col("g") + F.sum("good").over(inside)) * F.lit(bad).cast("decimal(19,0)")  # whole numbers: ties stay ties
    best = scores.join(F.broadcast(before), "part").select("raw", gain.alias("gain")).agg(
        F.max(F.struct("gain", (-F.col("raw")).alias("turned"))).alias("best")).first()["best"]
    if best["gain"] <= 0:
        return scores.agg(F.min("raw")).first()[0]
    low = -best["turned"]
    high = scores.where(F.col("raw") > low).agg(F.min("raw")).first()[0]
    middle = (low + high) / 2
    return middle if middle > low else high


def fit_ranking(rows: DataFrame, ridge: float = 1e-3) -> QualityRanking:
    """Weights by Newton steps on the logistic loss over all pairs of a good and a bad row of ``good, features``.

    Every step reads ``rows`` once more. Without rows of both labels there are no pairs: every document then scores ``CUT``
    and none is rejected. What Spark adds in no fixed order is rounded, so that a table has one ranking.
    """
    width = len(FEATURES)
    of = [F.get("features", F.lit(i)) for i in range(width)]
    seen = rows.agg(F.count_if("good"), F.count_if(~F.col("good")), *[F.avg(c) for c in of], *[F.stddev_pop(c) for c in of]).first()
    good, bad = seen[:2]
    if not good or not bad:
        return QualityRanking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, spread = np.array([float(f"{x:.9g}") for x in seen[2:]]).reshape(2, width)
    ranking = QualityRanking(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(width), 0.0)
    gradient, bend = _slopes(rows, ranking, ridge)
    for _ in range(STEPS):
        step = -np.linalg.solve(bend, gradient)
        if np.abs(step).max() < 1e-10:
            break
        ahead = replace(ranking, weights=ranking.weights + step)
        slopes = _slopes(rows, ahead, ridge)
        while slopes[0] @ step > -0.9 * (gradient @ step):  # too far: the loss rises there as it falls here
            step /= 2
            ahead = replace(ranking, weights=ranking.weights + step)
            slopes = _slopes(rows, ahead, ridge)
        ranking, (gradient, bend) = ahead, slopes
    ranking = replace(ranking, weights=np.round(ranking.weights, 8) + 0.0)
    return replace(ranking, cut=_best_cut(rows, ranking, good, bad))


def _feature_rows(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = text_features(batch.column(place))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1) * len(FEATURES), pa.int32()), pa.array(features.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed], names=["id", "features"])
    return run


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityRanking:
    """A ranking from every document with a label (1 good, 0 bad).

    Labels that are null or of ids without a document count for nothing. The features are written once, under
    ``spark.checkpoint.dir``, and read by every step of the fit; no text is shuffled.
    """
    shipped(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    if known.count() <= FEW_LABELS:
        texts = texts.join(F.broadcast(known.select("id")), "id", "left_semi")
    shape = StructType([texts.schema["id"], StructField("features", ArrayType(DoubleType()))])
    rows = texts.mapInArrow(tidy(_feature_rows(texts.columns.index("text"))), shape).join(known, "id").select("good", "features")
    return fit_ranking(materialise(rows, "quality-features"))


def _score(ranking: QualityRanking, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = ranking.score(text_features(batch.column(place)))
            yield with_columns(batch, {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= CUT).astype(np.int32), pa.int32())})
    return run


def score_quality(docs: DataFrame, ranking: QualityRanking, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 if the score is ``CUT`` or more).

    Every row gets both, from its whole text alone; null, empty and wordless texts have all features 0.
    An empty table gives no rows. Columns of ``docs`` with these two names are replaced.
    """
    shipped(docs.sparkSession)
    rest = docs.drop("score", "predicted")
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rest.mapInArrow(tidy(_score(ranking, rest.columns.index(text_col))), schema)
