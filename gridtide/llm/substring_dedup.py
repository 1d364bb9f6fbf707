"""Repeated passages: every word covered by a run of words that starts more than once in the corpus.

Matching runs over compressed full-text indexes (FM-index: Burrows-Wheeler transform with ranks on a
wavelet matrix), one per shard. A shard has to hold both sides of every repeat and no more than it
must, so windows are dealt by content:

1. Equal texts count once, with their number of copies. With two or more, all their windows repeat.
2. Every window of ``window`` words has an anchor: the smallest hash of the ``ANCHOR``-word runs inside.
   Equal windows have equal anchors. Anchors that occur once in the corpus cannot hold a repeat.
3. Consecutive windows with one anchor form a segment. Segments of repeated anchors are dealt to shards
   by anchor; equal segments are counted before that. An anchor with very many different segments goes
   to no shard: its windows are counted by a digest of their words, whole windows being all there is to match.
4. A shard indexes its segments and streams them against the index: backward search extends a match to
   the left while it occurs twice, which gives the matching windows as intervals.
5. Intervals go back to the texts, which lose the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridtide.llm.hash_filter import build_filter
from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import Words, rolling_hashes, slices, tidy, with_columns
from gridtide.session import materialise

ANCHOR = 8                  # words of an anchor at most
SHARD_BYTES = 2 << 20       # text of a shard, about
HOT_SEGMENTS = 20_000       # different segments of one anchor; beyond, its windows are counted one by one
BROADCAST_BYTES = 8 << 20   # text keys or intervals sent to every executor at most; beyond, a shuffled join
ROW_BYTES = 32              # of a key in a broadcast, about


# --- compressed full-text index ------------------------------------------------------------------------------------------

class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector per bit of a symbol, counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(symbols), []
        current = symbols
        for bit in range(bits - 1, -1, -1):
            ones = ((current >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.levels.append((bit, words, counts, len(symbols) - int(counts[-1])))
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place; ``begins``: where the symbol's run begins on the last level."""
        at = places
        for bit, words, counts, zeros in self.levels:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at - begins


class FMIndex:
    """Counts of patterns of up to ``depth`` symbols in a text of symbols 1.. with 0 between its parts."""

    def __init__(self, text: np.ndarray, depth: int):
        n, sigma = len(text), int(text.max()) + 1
        rank, width = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:  # suffixes by their first 2 * width symbols; beyond the depth their order does not matter
            ahead = np.zeros(n, np.int64)
            ahead[:-width or None] = rank[width:] + 1 if width < n else 0
            key = rank * np.int64(n + sigma + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1:
                break
        before = text[order - 1]  # of the first suffix: the last symbol, a separator
        self.size = n
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        bits = max(1, int(sigma - 1).bit_length())
        self.tree = WaveletMatrix(before.astype(np.int64), bits)
        flipped = np.zeros(sigma, np.int64)  # the last level sorts by reversed bits
        for bit in range(bits):
            flipped |= ((np.arange(sigma) >> bit) & 1) << (bits - 1 - bit)
        by = np.argsort(flipped, kind="stable")
        begin = np.zeros(sigma, np.int64)
        counts = np.bincount(text, minlength=sigma)
        begin[by] = np.cumsum(counts[by]) - counts[by]
        self.begins = begin

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns with one more symbol on the left."""
        begins, base = self.begins[symbols], self.starts[symbols]
        both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]), np.concatenate([begins, begins]))
        return base + both[:len(symbols)], base + both[len(symbols):]


def _reach(index: FMIndex, text: np.ndarray, base: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The leftmost place, ``limit`` at least, from which each pattern up to ``end`` occurs twice or more."""
    at, lo, hi = end.copy(), np.zeros(len(end), np.int64), np.full(len(end), index.size, np.int64)
    live = np.flatnonzero(at > limit)
    while len(live):
        symbols = text[base[live] + at[live] - 1]
        lo2, hi2 = index.extend(symbols, lo[live], hi[live])
        good = hi2 - lo2 >= 2
        live = live[good]
        at[live] -= 1
        lo[live], hi[live] = lo2[good], hi2[good]
        live = live[at[live] > limit[live]]
    return at


def repeated_windows(segments: list[np.ndarray], sure: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(segment, first, last) window starts that occur twice or more among all segments' windows.

    Segments are arrays of word hashes; those marked ``sure`` occur more than once as a whole.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    found = [(i, 0, int(sizes[i]) - window) for i in np.flatnonzero(sure)]
    todo = np.flatnonzero(~sure)
    if not len(todo):
        return found
    flat = np.concatenate(segments)
    _, symbols = np.unique(flat, return_inverse=True)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols.reshape(-1) + 1
    index = FMIndex(text, int(sizes.max()))
    base, first, last, who = begin[todo], np.zeros(len(todo), np.int64), sizes[todo] - window, todo
    while len(who):
        # from the right end: what matches there, in one walk
        end = last + window
        at = _reach(index, text, base, end, first)
        hit = at <= last
        found += zip(who[hit].tolist(), at[hit].tolist(), last[hit].tolist())
        last = np.where(hit, at, last) - 1
        live = first <= last
        base, first, last, who = base[live], first[live], last[live], who[live]
        if not len(who):
            break
        # from the left: a mismatch rules out every window start up to it
        at = _reach(index, text, base, first + window, first)
        hit = at <= first
        found += zip(who[hit].tolist(), first[hit].tolist(), first[hit].tolist())
        first = np.where(hit, first + 1, at)
        live = first <= last
        base, first, last, who = base[live], first[live], last[live], who[live]
    return found


# --- anchors and segments ----------------------------------------------------------------------------------------------

def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window its anchor's place, and the hashes of all runs; the leftmost smallest hash wins."""
    k = min(ANCHOR, window)
    runs = rolling_hashes(words, k)
    width = window - k + 1
    if width == 1:
        return np.arange(len(runs)), runs
    least = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1)
    return least + np.arange(len(least)), runs


def _texts_of(column: pa.Array, window: int):
    """(row, word hashes, word places) of the texts with a window."""
    for lo, _, data, offsets in slices(column):
        words = Words(data, offsets)
        hashes = words.hashes()
        for i in range(len(offsets) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= window:
                yield lo + i, hashes[a:b], data, words.start[a:b], words.end[a:b]


def _anchor_rows(window: int):
    schema = pa.schema([("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for _, hashes, *_ in _texts_of(batch.column("text"), window):
                places, runs = _anchors(hashes, window)
                out.append(runs[places[np.flatnonzero(np.diff(places, prepend=-1))]])
                held += len(out[-1])
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], schema=schema)
    return run


def _segment_rows(window: int, filter_):
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [[] for _ in range(7)], 0

            def packed():
                return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(rows)], schema=schema)

            k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
            for row, hashes, data, begin, end in _texts_of(batch.column("text"), window):
                places, runs = _anchors(hashes, window)
                first = np.flatnonzero(np.diff(places, prepend=-1))
                anchors = runs[places[first]]
                kept = filter_.value.passes(anchors)
                stop = np.append(first[1:], len(places))
                for i in np.flatnonzero(kept):
                    a, b = int(first[i]), int(stop[i])
                    words = data[begin[a]:end[b + window - 2]].tobytes()
                    cells = (int(anchors[i:i + 1].view(np.int64)[0]), hashlib.blake2b(words, digest_size=16).digest(),
                             k1[row], k2[row], a, b - a, words.decode("utf-8", "replace"))
                    for column, cell in zip(rows, cells):
                        column.append(cell)
                    held += len(words)
                if held > 1 << 21:
                    yield packed()
                    rows, held = [[] for _ in range(7)], 0
            if rows[0]:
                yield packed()
    return run


def _windows_apart(window: int):
    """Each window of a segment by a digest of its words, whatever stands between them."""
    schema = pa.schema([("segment", pa.binary()), ("from", pa.int32()), ("times", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, times = batch.column("segment").to_pylist(), batch.column("times").to_pylist()
            out = [[] for _ in range(4)]
            for row, hashes, *_ in _texts_of(batch.column("words"), window):
                raw, n = hashes.tobytes(), len(hashes) - window + 1
                out[0] += [segment[row]] * n
                out[1] += range(n)
                out[2] += [times[row]] * n
                out[3] += [hashlib.blake2b(raw[8 * i:8 * (i + window)], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(out)], schema=schema)
    return run


def _repeated_apart(windows: DataFrame) -> DataFrame:
    """The windows whose digest occurs more than once, as ``segment, lo, hi``; ``windows`` is a written table.

    Digests are counted before the shuffle. Those of very many rows, few by their nature, are broadcast, so that
    no task of the join gets all the rows of a common passage.
    """
    counted = materialise(windows.groupBy("digest").agg(F.sum("times").alias("all"), F.count("*").alias("rows")).where("all > 1"), "digests")
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    most = BROADCAST_BYTES // ROW_BYTES
    place = [F.col("from").alias("lo"), F.col("from").alias("hi")]
    if n <= most:
        return windows.join(F.broadcast(counted.select("digest")), "digest").select("segment", *place)
    many = F.broadcast(counted.where(F.col("rows") > total // most).select("digest", F.lit(True).alias("common")))
    marked = windows.join(many, "digest", "left")
    rest = marked.where(F.col("common").isNull()).drop("common").join(counted.select("digest"), "digest")
    return marked.where("common").select("segment", *place).unionByName(rest.select("segment", *place))


def _match(window: int):
    """One shard: index its segments, stream them, report repeated window starts per segment."""
    schema = pa.schema([("segment", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = table.column("words").combine_chunks()
        segments = [h for _, h, *_ in _texts_of(words, window)]
        sure = np.asarray(table.column("times").to_numpy() > 1)
        found = repeated_windows(segments, sure, window)
        who = np.array([f[0] for f in found], np.int64)
        return pa.table([table.column("segment").combine_chunks().take(pa.array(who)),
                         pa.array(np.array([f[1] for f in found], np.int32)),
                         pa.array(np.array([f[2] for f in found], np.int32))], schema=schema)
    return run


def _merge(window: int):
    """Per text the covered word ranges, joined where they touch, as pairs of 32-bit numbers."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ranges", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                lo, hi = (spans.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))
                last = np.append(first[1:], len(lo)) - 1
                out.append(np.stack([lo[first], end[last]], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, pa.binary())], schema=schema)
    return run


def _strip(window: int, at: dict[str, int]):
    """Texts without the words of their ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for text, ranges, copies in zip(*(batch.column(at[c]) for c in ("text", "ranges", "copies"))):
                words = (text.as_py() or "").encode("utf-8").split()  # at ASCII white space, as bytes split
                n = len(words)
                if n >= window and (copies.as_py() or 1) > 1:
                    words = []
                elif ranges.is_valid:
                    keep = np.ones(n, bool)
                    for lo, hi in np.frombuffer(ranges.as_py(), "<i4").reshape(-1, 2).tolist():
                        keep[lo:hi] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept.append(b" ".join(words).decode("utf-8"))
                total.append(n)
                removed.append(n - len(words))
            new = {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield with_columns(batch, new, (at["ranges"], at["copies"]))
    return run


def _bounded(table: DataFrame, payload: str | None = None) -> DataFrame:
    """A written table, to be sent to every executor if its bytes are few enough."""
    size = F.count("*") * ROW_BYTES + (F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)) if payload else F.lit(0))
    return F.broadcast(table) if table.agg(size).first()[0] <= BROADCAST_BYTES else table


def repeated_spans(docs: DataFrame, window: int = 50, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: text keys with copies (over 1), and covered word ranges per text key."""
    spark = shipped(docs.sparkSession)
    keyed = docs.where(F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"), F.col(text_col).alias("text"))
    copies = materialise(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    sent = _bounded(copies)
    several = materialise(keyed.join(sent, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text")), "texts")
    base = keyed.join(sent, ["k1", "k2"], "left_anti").unionByName(several)

    anchors = base.select("text").mapInArrow(tidy(_anchor_rows(window)), "anchor long")
    repeated = materialise(anchors.groupBy("anchor").count().where("count > 1"), "anchors")
    known = spark.sparkContext.broadcast(build_filter(repeated, "anchor", repeated.count()))
    shape = "anchor long, segment binary, k1 long, k2 long, start int, windows int, words string"
    raw = materialise(base.mapInArrow(tidy(_segment_rows(window, known)), shape), "segments")
    known.destroy()  # what follows reads written tables
    # an anchor that passed by chance meets nothing in its shard
    different = materialise(raw.groupBy("anchor", "segment").agg(F.first("words").alias("words"), F.count("*").alias("times")), "different")
    per_anchor = different.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("all"), F.sum(F.octet_length("words")).alias("bytes"))
    sizes = materialise(per_anchor.where("all > 1"), "sizes")
    calm = F.col("n") <= HOT_SEGMENTS
    volume, crowded = sizes.agg(F.sum(F.when(calm, F.col("bytes"))), F.count_if(~calm)).first()
    shards = max(12, -(-(volume or 0) // SHARD_BYTES))
    live = different.join(sizes.select("anchor", "n"), "anchor")
    dealt = live.where(calm).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = dealt.select("shard", "segment", "times", "words").groupBy("shard").applyInArrow(_match(window), "segment binary, lo int, hi int")
    if crowded:
        apart = live.where(~calm).select("segment", "times", "words").mapInArrow(
            _windows_apart(window), "segment binary, from int, times long, digest binary")
        found = found.unionByName(_repeated_apart(materialise(apart, "windows")))
    placed = raw.select("segment", "k1", "k2", "start").join(found, "segment")
    spans = placed.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"),
                                                                   (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    return copies, materialise(spans.mapInArrow(tidy(_merge(window)), "k1 long, k2 long, ranges binary"), "ranges")


def remove_repeats(docs: DataFrame, window: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: its words without repeated passages, one space between.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. A word goes when a run of
    ``window`` words that covers it starts anywhere else too, in its own text or another row, judged on
    the input. Equal rows are two places. Null, empty and wordless texts have no words and keep the empty
    text; a text shorter than the window keeps all its words. An empty table gives no rows. Columns of
    ``docs`` with the three new names are replaced, all others pass.
    """
    copies, ranges = repeated_spans(docs, window, text_col)
    own = docs.drop("n_words", "n_removed", "kept_text")
    joined = own.withColumns({"__k1": F.xxhash64(text_col), "__k2": F.xxhash64(F.lit(1), text_col)})
    sides = {"copies": _bounded(copies), "ranges": _bounded(ranges, "ranges")}
    for name, side in sides.items():
        joined = joined.join(side.withColumnsRenamed({"k1": "__k1", "k2": "__k2", name: f"__{name}"}), ["__k1", "__k2"], "left")
    joined = joined.select(*own.columns, "__ranges", "__copies")
    schema = StructType([*own.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType())])
    at = {"text": joined.columns.index(text_col), "ranges": len(own.columns), "copies": len(own.columns) + 1}
    return joined.mapInArrow(tidy(_strip(window, at)), schema)
