"""Linear recurrences unfolded over any horizon."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.plans.packs import per_row

BLOCK = 512  # steps that one row unfolds


def companion(values: np.ndarray, moving: np.ndarray, constant: float) -> np.ndarray:
    """The matrix that moves (latest values, latest shocks, 1) one step on, without a new shock."""
    n, m = max(len(values), 1), len(moving)
    step = np.zeros((n + m + 1, n + m + 1))
    step[0, :len(values)], step[0, n:n + m], step[0, -1] = values, moving, constant
    step[np.arange(1, n), np.arange(n - 1)] = 1
    step[np.arange(n + 1, n + m), np.arange(n, n + m - 1)] = 1
    step[-1, -1] = 1
    return step


def state_of(values: np.ndarray, shocks: np.ndarray, width: int) -> np.ndarray:
    """The state after lists of values (of which the last ``width`` count) and shocks, the latest last in both."""
    late = np.asarray(values)[::-1][:width]
    return np.concatenate([late, np.zeros(width - len(late)), np.asarray(shocks)[::-1], [1.0]])


def unfolded(models: DataFrame, steps: int, make: Callable[[dict], tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> DataFrame:
    """``_series, step, slot, p``: ``steps`` values after position ``end`` of every row of ``models``.

    ``make`` gives the matrix and the state of a row. A power of the matrix gives the state every ``block`` steps, so
    blocks are rows of their own and no task grows with ``steps``.
    """
    if steps < 1:
        raise ValueError("a forecast has one step at least")
    blocks = -(-steps // block)
    rows = models.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def unfold(row: dict) -> list[dict]:
        step, state = make(row)
        lo = row["block"] * block
        state = np.linalg.matrix_power(step, lo) @ state
        out = []
        for i in range(lo, min(lo + block, steps)):
            state = step @ state
            out.append({"step": i, "slot": row["end"] + 1 + i, "p": float(state[0])})
        return out

    spread = rows.repartition(F.col("_series"), F.col("block")) if blocks > 1 else rows
    return per_row(spread, unfold, "step long, slot long, p double")
