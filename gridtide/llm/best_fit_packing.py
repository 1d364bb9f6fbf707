"""Token sequences packed into bins of one size, by minimum bin slack.

Documents become token ids with an end id; only those longer than a bin are cut. Packing needs the
lengths alone, and there are as many lengths as a bin has places, whatever the corpus: the plan is made
on the table of counts per length and says which ranks of each length go where. Each bin starts with
the longest piece left and is filled by a subset-sum over the lengths left, held as bits of one
integer; the fullest combination is taken out as many times as the counts allow before the next is sought.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import tidy, with_columns
from gridtide.session import materialise

SALT_ROWS = 500_000  # pieces of one length that one task numbers, about
MAX_SALTS = 1 << 16
# Fixed value: the pattern that splits text before byte-level merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _encoders(model: str) -> tuple[tiktoken.Encoding, Tokenizer, tuple[str, ...]]:
    """The same vocabulary in a fast encoder, in its own library, and the strings only the latter knows."""
    spec = json.loads(model)
    special = tuple(x["content"] for x in spec["added_tokens"])
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_str(model), special


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read on the driver. Fails unless it is plain byte-level BPE with ids in merge order."""
    with open(path, encoding="utf-8") as file:
        model = file.read()
    spec = json.loads(model)
    vocabulary, before = spec["model"]["vocab"], spec["pre_tokenizer"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    plain = before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}
    if not plain or spec["normalizer"] is not None or merged != sorted(merged):
        raise ValueError("only byte-level BPE without normalisation and with ids in merge order is taken")
    return model


def _ids(text: str, encoders) -> np.ndarray:
    fast, own, special = encoders
    if not any(x in text for x in special):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as error:  # the fast one's pattern gives up on very long runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


def _cut(model: str, size: int, end_id: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(model)
        for batch in batches:
            rows, pieces, starts, lengths, values, held = [], [], [], [], [], 0

            def packed():
                cells = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                         pa.array(lengths, pa.int64()), pa.array(values, pa.binary())]
                return pa.RecordBatch.from_arrays(cells, schema=schema)

            for row, text in enumerate(batch.column(1)):
                ids = np.append(_ids(text.as_py() or "", encoders), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % size + 1  # the first piece takes what the full ones leave
                bounds = [0, *range(first, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    values.append(ids[a:b].tobytes())
                held += len(ids)
                if held > 1 << 20:
                    yield packed()
                    rows, pieces, starts, lengths, values, held = [], [], [], [], [], 0
            if rows:
                yield packed()
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids`` of every row: its ids and ``end_id``, cut only if over ``size``.

    ``ids`` are little-endian unsigned 32-bit. The first piece of a cut document may be shorter than
    ``size``, the others are full. Null and empty texts are one piece of the end id; rows that repeat an
    id are documents of their own; an empty table gives no rows; other columns are not read.
    """
    shipped(docs.sparkSession)
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = table.schema["id"].dataType
    schema = StructType.fromDDL(f"id {kind.simpleString()}, piece int, start long, length long, ids binary")
    cut = table.mapInArrow(tidy(_cut(read_tokenizer(tokenizer_path), size, end_id, to_arrow_schema(schema).field(0).type), _encoders), schema)
    return cut.withColumnRenamed("id", id_col)


@dataclass
class Plan:
    """Where the k-th piece of a length goes: runs of ranks, sorted by length and first rank."""

    length: np.ndarray
    rank: np.ndarray      # first rank of the run
    sequence: np.ndarray  # the run's first bin
    times: np.ndarray     # pieces of this length per bin
    offset: np.ndarray    # place of the first of them in its bin
    bins: int


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths with multiplicities that fill ``room`` as far as any choice does, longer ones first."""
    reach, steps = 1, []
    full = 1 << room
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies make any number up to the count
            take = min(part, left)
            new = reach | ((reach << (length * take)) & mask)
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            part *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_bins(counts: dict[int, int], size: int) -> Plan:
    """The whole packing from the counts per length. At most some thousand different bins, for any corpus."""
    left = {k: v for k, v in counts.items() if v > 0}
    if left and (min(left) < 1 or max(left) > size):
        raise ValueError(f"lengths must be 1 to {size}")
    used, rows, bins = dict.fromkeys(left, 0), [], 0
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        chosen = _fullest(rest, size - seed) if rest and size > seed else {}
        chosen[seed] = chosen.get(seed, 0) + 1
        repeat = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], bins, n, offset))
            used[length] += n * repeat
            offset += n * length
            left[length] -= n * repeat
            if not left[length]:
                del left[length]
        bins += repeat
    columns = [np.array(c, np.int64) for c in zip(*sorted(rows))] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, bins)


def _assign(plan: Plan, length_at: int, rank_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.int64(1) << np.int64(46)
        keys = plan.length * top + plan.rank
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (length_at, rank_at))
            row = np.searchsorted(keys, length * top + rank, side="right") - 1
            nth = rank - plan.rank[row]
            sequence = plan.sequence[row] + nth // plan.times[row]
            offset = plan.offset[row] + nth % plan.times[row] * length
            yield with_columns(batch, {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}, (rank_at,))
    return run


def pack(pieces: DataFrame, size: int = 1024, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in bins of ``size``.

    ``pieces`` must give the same rows each time it is read (a written table). Lengths must be 1 to
    ``size``; others, and nulls, raise an error. No row is dropped; equal rows get places of their own.
    Columns of ``pieces`` called ``sequence_id`` or ``offset`` are replaced.
    """
    shipped(pieces.sparkSession)
    rows = pieces.drop("sequence_id", "offset")
    counted = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}  # one row per length: size at most, else an error follows
    if None in counted:
        raise ValueError("a length is null")
    plan = plan_bins(counted, size)
    salts = min(MAX_SALTS, max(8, -(-max(counted.values(), default=0) // SALT_ROWS)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    per_salt = salted.groupBy(F.col(length_col).alias("_length"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per salt
    bases = per_salt.select("_length", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(length_col, "_salt").orderBy(*[F.col(c) for c in rows.columns])
    ranked = (salted.withColumn("_nth", F.row_number().over(own).cast("long") - 1)
              .join(bases, (F.col(length_col) == F.col("_length")) & (F.col("_salt") == F.col("_s")))
              .select(*rows.columns, (F.col("_nth") + F.col("_base")).alias("_rank")))
    schema = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(tidy(_assign(plan, ranked.columns.index(length_col), len(rows.columns))), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their checksum and place; the ids come again from ``token_pieces``."""
    pieces = token_pieces(docs, tokenizer_path, size, end_id, id_col, text_col)
    written = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(written, size)
