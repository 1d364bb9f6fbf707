"""Words of many texts at once as 64-bit hashes, in numpy over Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64 bits: two different words
(or word sequences) of a corpus with N distinct ones share a hash with probability about N*N/2**65.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240611)
_TABLE = _RNG.integers(0, 2**64, size=32 * 256, dtype=np.uint64)  # one random value per place and byte
_BLOCK = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.arange(1, 65, dtype=np.uint64) * _BLOCK
_GRAM = _RNG.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_HELD: list = []  # the cached builder whose model this worker holds


def hold_only(builder=None) -> None:
    """Drop the models that other stages have left in this worker; ``builder`` is a cached function that keeps its own."""
    for held in [x for x in _HELD if x is not builder]:
        held.cache_clear()
        _HELD.remove(held)
    if builder is not None and builder not in _HELD:
        _HELD.append(builder)


def tidy(run, builder=None):
    """The same batch function for workers that live on between stages.

    At its start the worker drops the models of other stages, at the end of a task it gives freed memory back. The model
    of ``builder`` stays for the stage's next task.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(builder)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)
    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text begins and ends; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    offset_type = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=offset_type)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; a longer text is a run."""
    if not len(column):
        return
    data, offsets = raw_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], without: tuple[int, ...] = ()) -> pa.RecordBatch:
    """The batch with more columns at its end; the others keep the types they came with."""
    kept = [i for i in range(batch.num_columns) if i not in without]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new.values()], names=[*[batch.schema.names[i] for i in kept], *new])


class Words:
    """The words of a run of texts: ``start``/``end`` byte places, ``first`` word of each text (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        word = IS_WORD[self.data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]  # a text begins and ends its words at its own border
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        begins[head], ends[tail] = word[head], word[tail]
        self.word = word
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), length)
        value = _TABLE[((place & 31) << 8) | self.data[self.word]]
        if int(length.max()) > 32:
            power = np.cumprod(np.full(int(length.max()) // 32 + 2, _BLOCK, dtype=np.uint64))
            late = np.flatnonzero(place >= 32)  # shorter words must not depend on their neighbours
            value[late] *= power[place[late] >> 5]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * _BLOCK)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` word hashes; of a shorter sequence, none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += mix(words[i:i + m] + _PLACE[i % 64]) * _GRAM[i % 64]
    return mix(out)


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As ``gram_hashes`` for long runs, in one pass by a polynomial of running sums."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(len(words) + 1, _GRAM[0], dtype=np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * power[:-1])])
    return mix((run[n:] - run[:-n]) * _inverse_powers(len(words))[:m])


_INVERSES = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """Inverse powers of the polynomial's base modulo 2**64."""
    global _INVERSES
    if len(_INVERSES) < n + 1:
        base = pow(int(_GRAM[0]), -1, 2**64)
        _INVERSES = np.cumprod(np.full(2 * n + 1, np.uint64(base), dtype=np.uint64))
    return _INVERSES


def shingle_sets(column: pa.Array, n: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted distinct shingle hashes, rarest word of each) of every text with a word.

    The third array holds, for every distinct shingle, the hashes of its words as rows of a matrix.
    A text of fewer than ``n`` words has its whole sequence as its one shingle.
    """
    for lo, _, data, offsets in slices(column):
        words = Words(data, offsets, lower)
        hashes = words.hashes()
        grams = gram_hashes(hashes, n)
        for i in range(len(offsets) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            if b - a < n:
                yield lo + i, gram_hashes(hashes[a:b], b - a), np.resize(hashes[a:b], (1, n))
                continue
            distinct, at = np.unique(grams[a:b - n + 1], return_index=True)
            yield lo + i, distinct, hashes[a + at[:, None] + np.arange(n)]
