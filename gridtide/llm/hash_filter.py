"""A bitmap of bounded size over 64-bit keys, so that most rows without a partner never reach a shuffle.

Every key of the table passes; others pass now and then, which an exact join behind the filter corrects.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtide.llm.textkit import mix, tidy

MOST_BITS = 1 << 28    # 32 MB, whatever the number of keys
CHUNK_BITS = 1 << 22


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)


@dataclass
class HashFilter:
    bits: int
    bitmap: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys, self.bits)
        return (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _with_chunk(bits: int):
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = _slots(batch.column(0).to_numpy(), bits) // CHUNK_BITS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunk.astype(np.int32))], schema=schema)
    return run


def _chunk_bitmaps(bits: int):
    """A chunk's keys are all in one partition; its bitmap has a fixed size."""
    schema = pa.schema([("chunk", pa.int32()), ("bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _slots(batch.column("key").to_numpy(), bits)
            of = slot // CHUNK_BITS
            for chunk in np.unique(of):
                chunks.setdefault(int(chunk), np.zeros(min(bits, CHUNK_BITS), bool))[slot[of == chunk] % CHUNK_BITS] = True
        for chunk, flags in chunks.items():
            bitmap = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bitmap], pa.binary())], schema=schema)
    return run


def build_filter(keys: DataFrame, column: str, count: int) -> HashFilter:
    """The filter of a written table's keys (longs), 16 bits for each of ``count`` up to ``MOST_BITS`` in all."""
    bits = 1 << max(16, min((16 * max(count, 1) - 1).bit_length(), (MOST_BITS - 1).bit_length()))
    bitmap = np.zeros((-(-bits // CHUNK_BITS), min(bits, CHUNK_BITS) // 8), np.uint8)
    rows = keys.selectExpr(f"{column} as key").mapInArrow(tidy(_with_chunk(bits)), "key long, chunk int")
    for row in rows.repartition("chunk").mapInArrow(tidy(_chunk_bitmaps(bits)), "chunk int, bitmap binary").toLocalIterator():
        bitmap[row["chunk"]] = np.frombuffer(zlib.decompress(bytes(row["bitmap"])), np.uint8)
    return HashFilter(bits, bitmap.reshape(-1))
