"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Every byte of a text gets a probability per language; a document's are pooled over its letters' places. Texts are
cut into windows of a fixed number of bytes that run side by side as columns of one matrix, so the
network works at matrix speed and a text of any length costs the same per byte. The network is
trained by backpropagation through time on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import raw_bytes, tidy, with_columns

WINDOW = 96          # bytes of a text that run as one sequence
COLUMNS = 2048       # windows that run side by side
HIDDEN = 8           # units per direction
SAMPLE_DOCS = 2400   # labelled documents to learn from, at most
SAMPLE_CHARS = 100_000    # of a longer text, so many characters from a place its hash gives
MOST_LABELS = 1_000       # more are an error, not a cut
SAMPLE_WINDOWS = 16_000   # windows of 64 bytes from anywhere in them, at most
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Weights: per direction, byte table (256, 3H), recurrent matrix (H, 3H) and one read-out (2H, classes)."""

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(table: np.ndarray, matrix: np.ndarray, steps: np.ndarray, keep: bool = False):
    """States after each step (steps, columns, H). Gates in order: update, reset, candidate."""
    hidden = matrix.shape[0]
    state = np.zeros((steps.shape[1], hidden), np.float32)
    states = np.empty((len(steps), steps.shape[1], hidden), np.float32)
    cache = []
    for t, codes in enumerate(steps):
        given = table[codes]
        gates = _sigmoid_fast(given[:, :2 * hidden] + state @ matrix[:, :2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        candidate = np.tanh(given[:, 2 * hidden:] + (reset * state) @ matrix[:, 2 * hidden:])
        if keep:
            cache.append((state, update, reset, candidate))
        state = state + update * (candidate - state)
        states[t] = state
    return states, cache


def _sigmoid_fast(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _back(table, matrix, steps, cache, grads):
    """Gradients of table and recurrent matrix from the gradient at every state (through time)."""
    hidden = matrix.shape[0]
    d_table, d_matrix = np.zeros_like(table), np.zeros_like(matrix)
    carry = np.zeros_like(grads[0])
    for t in range(len(steps) - 1, -1, -1):
        state, update, reset, candidate = cache[t]
        d = grads[t] + carry
        d_candidate = d * update * (1 - candidate * candidate)
        d_update = d * (candidate - state) * update * (1 - update)
        d_gated = d_candidate @ matrix[:, 2 * hidden:].T
        d_reset = d_gated * state * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        carry = d * (1 - update) + d_gated * reset + d_gates @ matrix[:, :2 * hidden].T
        d_matrix[:, :2 * hidden] += state.T @ d_gates
        d_matrix[:, 2 * hidden:] += (reset * state).T @ d_candidate
        np.add.at(d_table, steps[t], np.concatenate([d_gates, d_candidate], axis=1))
    return d_table, d_matrix


def _windows(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first byte of every window, without its bytes."""
    per_text = -(-np.diff(offsets) // length)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return owner, offsets[owner] + nth * length


def _codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """(length, columns) byte codes of some windows of texts that end at ``end``, padded with 0."""
    if not len(begin):
        return np.zeros((length, 0), np.uint8)
    place = begin[:, None] + np.arange(length)
    codes = np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0)
    return np.ascontiguousarray(codes.T)


def train_network(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, length: int = 64, epochs: int = 5,
                  batch: int = 256, rate: float = 0.02, windows: int = SAMPLE_WINDOWS, seed: int = 7) -> ByteNetwork:
    """Learn from windows anywhere in the texts: each byte of a letter is to be labelled with its text's label.

    At most ``windows`` windows, as many per label as there are.
    """
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner, begin = _windows(offsets, length)
    of = {name: i for i, name in enumerate(names)}
    wanted = np.array([of[x] for x in labels])[owner]
    picked = np.concatenate([rng.permutation(np.flatnonzero(wanted == i))[:max(1, windows // len(names))] for i in range(len(names))])
    owner, wanted = owner[picked], wanted[picked]
    codes = _codes(data, begin[picked], offsets[owner + 1], length)
    share = np.bincount(wanted, minlength=len(names)) / max(len(wanted), 1)
    weight = (1.0 / np.maximum(share, 1e-9) / len(names)).astype(np.float32)  # classes count alike
    scale = 1 / np.sqrt(hidden)
    weights = [rng.normal(0, 0.3, (256, 3 * hidden)), rng.normal(0, 0.3, (256, 3 * hidden)), rng.normal(0, scale, (hidden, 3 * hidden)),
               rng.normal(0, scale, (hidden, 3 * hidden)), rng.normal(0, scale, (2 * hidden, len(names))), np.zeros(len(names))]
    weights = [w.astype(np.float32) for w in weights]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = epochs * -(-len(owner) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(owner))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            steps, target = codes[:, pick], wanted[pick]
            forth, kept_f = _run(weights[0], weights[2], steps, keep=True)
            back, kept_b = _run(weights[1], weights[3], steps[::-1], keep=True)
            states = np.concatenate([forth, back[::-1]], axis=2)
            logits = states @ weights[4] + weights[5]
            logits -= logits.max(axis=2, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=2, keepdims=True)
            chance[:, np.arange(len(pick)), target] -= 1
            counted = LETTER[steps].astype(np.float32) * weight[target]
            chance *= (counted / max(counted.sum(), 1.0))[:, :, None]
            flat = chance.reshape(-1, len(names))
            d_states = chance @ weights[4].T
            grads = [None] * 6
            grads[4], grads[5] = states.reshape(-1, 2 * hidden).T @ flat, flat.sum(axis=0)
            grads[0], grads[2] = _back(weights[0], weights[2], steps, kept_f, d_states[:, :, :hidden])
            grads[1], grads[3] = _back(weights[1], weights[3], steps[::-1], kept_b, d_states[::-1, :, hidden:])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            speed = rate * (1 - (step - 1) / rounds) * min(1.0, 1.0 / max(norm, 1e-9))
            for i, grad in enumerate(grads):  # Adam on gradients of bounded norm
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.01 * (grad * grad - second[i])
                weights[i] -= (speed if norm > 1 else rate * (1 - (step - 1) / rounds)) * (
                    first[i] / (1 - 0.9 ** step) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return ByteNetwork(names, weights[0:2], weights[2:4], weights[4], weights[5])


LETTER = np.zeros(256, dtype=bool)  # bytes of ASCII letters and of characters beyond ASCII
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def label_positions(network: ByteNetwork, codes: np.ndarray) -> np.ndarray:
    """Probabilities (steps, columns, classes) of every byte of every window."""
    forth, _ = _run(network.tables[0], network.recurrent[0], codes)
    back, _ = _run(network.tables[1], network.recurrent[1], codes[::-1])
    hidden = network.recurrent[0].shape[0]
    logits = forth @ network.out[:hidden]
    logits += back[::-1] @ network.out[hidden:]
    logits += network.bias
    np.clip(logits, -30, 30, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def document_probabilities(network: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability per language over the places of letters; 0 for a text without any."""
    total, places = np.zeros((len(offsets) - 1, max(len(network.labels), 1))), np.zeros(len(offsets) - 1)
    if not network.labels:
        return total
    owner, start = _windows(offsets, WINDOW)
    columns = max(1, COLUMNS * 32 // max(32, len(network.labels)))  # the matrix of probabilities keeps its size
    for lo in range(0, len(owner), columns):
        own = owner[lo:lo + columns]
        part = _codes(data, start[lo:lo + columns], offsets[own + 1], WINDOW)
        counted = LETTER[part]
        chance = label_positions(network, part)
        chance *= counted[:, :, None]
        sums, begin = chance.sum(axis=0), np.flatnonzero(np.diff(own, prepend=-1))
        total[own[begin]] += np.add.reduceat(sums, begin, axis=0)
        places[own[begin]] += np.add.reduceat(counted.sum(axis=0), begin)
    return total / np.maximum(places, 1)[:, None]


def learn_languages(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE_DOCS,
                    seed_key: str = "doc_id") -> ByteNetwork:
    """A network from at most ``sample`` rows with text and label, as many of each label as there are, spread by a hash.

    Every label is learned; more than ``MOST_LABELS`` are an error. Of a text over ``SAMPLE_CHARS`` characters a part as
    long is learned. Equal rows and texts with two labels are rows like others. Without any labelled text, the network
    has no labels and calls every text ``und``.
    """
    known = labelled.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label_col}")
    if not counts:
        return ByteNetwork([], [], [], np.zeros((0, 0)), np.zeros(0))
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, 1_000_000 if n <= 2 * each else int(2_000_000 * each / n))])
    told = known.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(seed_key, text_col).alias("order"),
                        F.spark_partition_id().alias("task")).where(F.pmod("order", F.lit(1_000_000)) < share[F.col("label")])
    cut = F.pmod("order", F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    told = told.withColumn("text", F.substr("text", cut, F.lit(SAMPLE_CHARS)))
    for keys in (("label", "task"), ("label",)):  # the first of each task's rows, then the first of those
        first = Window.partitionBy(*keys).orderBy("order", "text")
        told = told.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).drop("nth")
    rows = sorted(told.select("label", "order", "text").collect())
    return train_network([r[2].encode("utf-8") for r in rows], [r[0] for r in rows])


def _predict(network: ByteNetwork, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*network.labels, UNKNOWN], dtype=object)
        for batch in batches:
            column = batch.column(place)
            labels, scores = [], []
            data, offsets = raw_bytes(column)
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WINDOW * COLUMNS, side="right")) - 1)
                chance = document_probabilities(network, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                best = chance.argmax(axis=1)
                score = chance[np.arange(len(best)), best]
                texts = column.slice(lo, hi - lo).to_pylist()
                blank = np.array([s == 0 or not any(c.isalpha() for c in t) for s, t in zip(score, texts)], dtype=bool)
                labels += names[np.where(blank, len(network.labels), best)].tolist()
                scores.append(np.where(blank, 0.0, np.clip(score, 0, 1)))
                lo = hi
            yield with_columns(batch, {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})
    return run


def predict_language(docs: DataFrame, network: ByteNetwork, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the pooled probability) from the whole text alone.

    A null text, and one without a letter, is ``und`` with score 0. One row per row, equal texts get equal
    results, an empty table gives no rows. Columns of ``docs`` called ``lang_pred`` or ``score`` are replaced.
    """
    shipped(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rest.mapInArrow(tidy(_predict(network, rest.columns.index(text_col))), schema)
