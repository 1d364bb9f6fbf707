"""SentencePiece ids of whole texts through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. When no piece of the
vocabulary has a marker behind another character, merges cannot cross from one chunk to the next, so
a text's ids are its chunks' ids one after the other. Each distinct chunk is segmented once:

1. Documents travel in compressed packs, dealt to blocks of a bounded number of bytes. A block lists its distinct chunks.
2. The lists are cut by the chunk's hash; a bucket holds one chunk from all blocks, and segments it once.
3. The ids go back to the blocks that asked, where documents take them by position.

Rows on the way are one per block and bucket, not one per word.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import slices, with_columns

MARK = "▁"
PACK_BYTES = 1 << 19     # text per pack of documents
BLOCK_BYTES = 12 << 20   # text per block
BUCKET_BYTES = 16 << 20  # corpus bytes per bucket of distinct chunks
MOST_BUCKETS = 4096      # so that a block's list per bucket stays worth a row
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


@functools.lru_cache(maxsize=2)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    """The model file, read on the driver; tasks get its bytes. Fails if its pieces can cross a marker."""
    with open(path, "rb") as file:
        model = file.read()
    processor = _processor(model)
    for i in range(processor.get_piece_size()):
        if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)):
            if not re.fullmatch(f"{MARK}*[^{MARK}]*", processor.id_to_piece(i)):
                raise ValueError("a piece crosses a whitespace marker; chunks cannot be segmented on their own")
    for text in ("a  b", " a ", "a 　b\t"):
        if processor.decode(processor.encode(text)) != text:
            raise ValueError("the model changes white space or characters; only models without normalisation are taken")
    return model


def chunks(text: str) -> list[str]:
    """The chunks of a text in order, each without its first marker and with spaces for the others.

    The model puts a marker before the text, so every chunk begins with one. An empty text has none.
    """
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    marked = MARK + text.replace(" ", MARK)
    return [run[1:].replace(MARK, " ") for run in _RUNS.findall(marked)]


def _chunk_ids(processor, wanted: list[str]) -> list[list[int]]:
    """Ids of chunks; the model adds the first marker itself, but not to an empty text."""
    out = processor.encode(wanted, num_threads=1)
    if "" in wanted:
        only = [processor.piece_to_id(MARK)]
        out = [ids if chunk else only for chunk, ids in zip(wanted, out)]
    return out


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _expand(payload: bytes) -> bytes:
    return pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True)


def _join(items: list[str]) -> bytes:
    """Strings as one compressed value; lengths first, since a chunk may hold any character."""
    data = [x.encode("utf-8") for x in items]
    return _squeeze(np.array([len(data), *map(len, data)], np.uint32).tobytes() + b"".join(data))


def _split(payload: bytes) -> list[str]:
    raw = _expand(payload)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    ends = np.cumsum(np.frombuffer(raw[4:4 + 4 * n], np.uint32).astype(np.int64)) + 4 + 4 * n
    begin, out = 4 + 4 * n, []
    for end in ends.tolist():
        out.append(raw[begin:end].decode("utf-8"))
        begin = end
    return out


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents as compressed Arrow tables."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in batches:
        for lo, hi, _, _ in slices(batch.column("text"), PACK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack"])


def _unpacked(packs: pa.Table) -> Iterator[pa.Table]:
    for pack in packs.column("pack"):
        yield pa.ipc.open_stream(pack.as_buffer()).read_all()


def _asked(packs: pa.Table, buckets: int) -> dict[int, list[str]]:
    """A block's distinct chunks by bucket, in order."""
    distinct: set[str] = set()
    for docs in _unpacked(packs):
        for text in docs.column("text"):
            distinct.update(chunks(text.as_py() or ""))
    lists: dict[int, list[str]] = {}
    for chunk in sorted(distinct):
        lists.setdefault(zlib.crc32(chunk.encode("utf-8")) % buckets, []).append(chunk)
    return lists


def _ask(buckets: int):
    """A block's distinct chunks, one row per bucket."""
    def run(packs: pa.Table) -> pa.Table:
        lists = _asked(packs, buckets)
        return pa.table({"block": pa.array([packs.column("block")[0].as_py()] * len(lists), pa.int64()),
                         "bucket": pa.array(list(lists), pa.int32()), "asked": pa.array([_join(x) for x in lists.values()], pa.binary())})
    return run


def _width(processor) -> type:
    return np.uint16 if processor.get_piece_size() <= 1 << 16 else np.int32


def _segment(model: bytes):
    """Segments each distinct chunk of a partition once and answers every block that asked."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("check", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, known, bucket = _processor(model), {}, None
        width = _width(processor)
        for batch in batches:
            for row in range(len(batch)):
                if batch.column("bucket")[row].as_py() != bucket:  # sorted by bucket: one bucket's chunks at a time
                    known, bucket = {}, batch.column("bucket")[row].as_py()
                payload = batch.column("asked")[row].as_py()
                asked = _split(payload)
                fresh = [x for x in asked if x not in known]
                for chunk, ids in zip(fresh, _chunk_ids(processor, fresh)):
                    known[chunk] = np.array(ids, width).tobytes()
                parts = [known[x] for x in asked]
                sizes = np.array([len(x) // width().itemsize for x in parts], np.int32)
                answer = _squeeze(sizes.tobytes() + b"".join(parts))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), batch.column("bucket").slice(row, 1),
                                                  pa.array([zlib.crc32(payload)], pa.int64()), pa.array([answer], pa.binary())], schema=schema)
    return run


def _place(model: bytes, buckets: int, decoded: bool):
    """Documents of a block with their ids, laid out by position from the block's answers, and their text again."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        processor = _processor(model)
        width = _width(processor)
        known: dict[str, bytes] = {}
        lists = _asked(packs, buckets)
        for bucket, check, answer in zip(*(answers.column(c) for c in ("bucket", "check", "ids"))):
            asked = lists.get(bucket.as_py(), [])
            if zlib.crc32(_join(asked)) != check.as_py():
                continue  # a block dealt anew after a lost executor may hold other documents
            raw = _expand(answer.as_py())
            end = (np.cumsum(np.frombuffer(raw, np.int32, len(asked)), dtype=np.int64) * width().itemsize + 4 * len(asked)).tolist()
            begin = 4 * len(asked)
            for chunk, stop in zip(asked, end):
                known[chunk] = raw[begin:stop]
                begin = stop
        del lists
        out = []
        for docs in _unpacked(packs):
            values, offsets, again = [], [0], []
            for text in docs.column("text"):
                parts = chunks(text.as_py() or "")
                try:
                    raw = b"".join([known[x] for x in parts])
                except KeyError:
                    raw = np.array(processor.encode(text.as_py()), width).tobytes()
                values.append(raw)
                offsets.append(offsets[-1] + len(raw) // width().itemsize)
                if decoded:
                    again.append(processor.decode(np.frombuffer(raw, width).tolist()))
            flat = pa.array(np.frombuffer(b"".join(values), width).astype(np.int32))
            columns = [docs.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
            out.append(pa.table(columns + [pa.array(again, pa.string())] * decoded, names=["id", "ids", "decoded"][:2 + decoded]))
        return pa.concat_tables(out)
    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``id_col`` and ``ids_col``: the ids the library gives the whole text, without begin or end ids.

    With ``decoded_col`` also the text that the library's ``decode`` gives for these ids, in the same task.
    One row per row of ``docs``, also for repeated rows and null ids; a null or empty text has no ids
    (an empty list). An empty table gives no rows. Other columns are not read.
    """
    spark = shipped(docs.sparkSession)
    model = read_model(model_path)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = max(12, -(-total // BLOCK_BYTES)), min(MOST_BUCKETS, max(12, -(-total // BUCKET_BYTES)))
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = table.mapInArrow(_packs, "pack binary").select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), "pack")
    asked = dealt.groupBy("block").applyInArrow(_ask(buckets), "block long, bucket int, asked binary")
    answers = (asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
               .mapInArrow(_segment(model), "block long, bucket int, check long, ids binary"))
    shape = f"id {table.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * bool(decoded_col)
    placed = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_place(model, buckets, bool(decoded_col)), shape)
    return placed.toDF(id_col, ids_col, *[decoded_col] * bool(decoded_col))


def _decoder(model: bytes, place: int, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        for batch in batches:
            column = batch.column(place)
            texts = [None if not x.is_valid else processor.decode(x.values.to_numpy().tolist()) for x in column]
            yield with_columns(batch, {into: pa.array(texts, pa.string())})
    return run


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids as the library's ``decode`` gives it; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    shipped(coded.sparkSession)
    rest = coded.drop(into)
    schema = StructType([*rest.schema.fields, StructField(into, StringType())])
    return rest.mapInArrow(_decoder(read_model(model_path), rest.columns.index(ids_col), into), schema)
