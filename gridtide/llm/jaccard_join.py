"""Near-duplicate documents: an exact Jaccard join on word shingles.

Rare-first prefix filtering. Two sets with similarity t or more share one of their first
``n - ceil(t * n) + 1`` shingles in any common order; the order used puts the rarest first, so the
lists that meet are short. Steps:

1. Documents with equal sets form a class; only classes are compared.
2. An upper bound of a shingle's frequency (the smallest of its own and its words' counts, in count
   tables of fixed size over all documents) gives the order. The bound only steers the cost: any
   common order finds every pair.
3. Classes meet on prefix shingles; length, position and suffix filters drop pairs that cannot reach t.
4. First each class is compared with the hub of each of its shingles only (the class that has the
   shingle foremost, as an unedited original does). What that links needs no more comparison inside:
   then only pairs from different components meet, and only those that meet on enough shingles stay.
   Each pair is verified once on whole sets.

Rows grow with the links that matter, not with the square of a group of copies. Every table that is
written goes when the last step that reads it is done, so the disk holds a step's rows, not all steps'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridtide.llm.components import connected_components
from gridtide.llm.hash_filter import HashFilter, build_filter
from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import mix, shingle_sets, tidy
from gridtide.session import discard, materialise

COUNTERS = 1 << 22    # entries of each count table, whatever the data's size
CHUNK = 1 << 16       # entries per row of a count table on its way
SALTS = 32            # first-step sums per chunk
BROADCAST_ROWS = 1_000_000  # class ids (8 bytes) sent to every executor at most; beyond, a shuffled join
PARTS = 512           # parts of the suffix filter, one bit each


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)  # the top 22 bits: COUNTERS entries


def _class_id(shingles: np.ndarray) -> int:
    total = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(shingles))
    return int(_signed(mix(np.array([total], np.uint64)))[0])


def _profile(n: int, lower: bool, id_type: pa.DataType):
    """Per document its set's size and class; at the end of a task its counts of words and shingles."""
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("cls", pa.int64()), ("parts", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, COUNTERS), np.uint32)
        for batch in batches:
            sizes, classes, parts = np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
            pending: list[list[np.ndarray]] = [[], []]

            def flush():
                for which in (0, 1):
                    if pending[which]:
                        slot, times = np.unique(np.concatenate(pending[which]), return_counts=True)
                        counts[which, slot] += times.astype(np.uint32)
                        pending[which].clear()

            held = 0
            for row, shingles, words in shingle_sets(batch.column(1), n, lower):
                sizes[row], classes[row] = len(shingles), _class_id(shingles)
                odd = np.bincount((shingles & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
                parts[row] = np.packbits(odd.astype(bool)).tobytes()
                pending[0].append(_slot(shingles))
                pending[1].append(_slot(words[:, 0]))
                held += len(shingles)
                if held > 1 << 19:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(parts, pa.binary()),
                 pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], schema=schema)
        yield from _count_rows(counts, schema)
    return run


def _count_rows(counts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zlib
    flat = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(flat.any(axis=1))
    if len(used):
        cells = [pa.array(used, pa.int32()), pa.array([zlib.compress(flat[i].tobytes(), 1) for i in used], pa.binary())]
        lead = [pa.nulls(len(used), schema.field(i).type) for i in range(len(schema) - 2)]
        yield pa.RecordBatch.from_arrays(lead + cells, schema=schema)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the count rows of a partition by chunk; at most ``2 * COUNTERS / CHUNK`` chunks are held."""
    import zlib
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(payload), np.uint32)
            kept = sums.setdefault(chunk, np.zeros(CHUNK, np.uint32))
            kept += np.minimum(part, np.uint32(0xFFFFFFFF) - kept)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], schema=schema)


def _levels(profile: DataFrame) -> np.ndarray:
    """Logarithmic frequency levels, one byte per entry of both tables: 8 MB on the driver at any size of data."""
    import zlib
    rows = profile.where("chunk is not null").select("chunk", "counts")
    first = rows.repartition(F.col("chunk"), F.pmod(F.xxhash64("counts"), F.lit(SALTS))).mapInArrow(tidy(_sum_counts), "chunk int, counts binary")
    total = materialise(first.repartition("chunk").mapInArrow(tidy(_sum_counts), "chunk int, counts binary"), "counts")
    levels = np.zeros((2 * COUNTERS // CHUNK, CHUNK), np.uint8)
    for row in total.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint32)
        levels[row["chunk"]] = np.minimum(255, np.round(8 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)
    discard(total)
    return levels.reshape(2, COUNTERS)


def _prefixes(n: int, lower: bool, percent: int, levels, known=None):
    """(shingle, class, set size, position) of the prefix of every document's set; only shingles that pass ``known``."""
    schema = pa.schema([("g", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_level, word_level = levels.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            held = 0
            for _, shingles, words in shingle_sets(batch.column(0), n, lower):
                size = len(shingles)
                take = size - -(-percent * size // 100) + 1
                level = np.minimum(gram_level[_slot(shingles)], word_level[_slot(words)].min(axis=1))
                prefix = shingles[np.argsort(level, kind="stable")[:take]]  # shingles are sorted: ties go by their hash
                places = np.arange(take) if known is None else np.flatnonzero(known.value.passes(prefix))
                if not len(places):
                    continue
                for column, cell in zip(out, (prefix[places].view(np.int64), _class_id(shingles), size, places)):
                    column.append(np.broadcast_to(cell, len(places)))
                held += len(places)
                if held > 1 << 17:
                    yield _batch(out, schema)
                    out, held = [[] for _ in range(4)], 0
            if held:
                yield _batch(out, schema)
    return run


def _batch(columns: list[list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _sets(n: int, lower: bool):
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets, held = [], [], 0
            for _, shingles, _ in shingle_sets(batch.column(0), n, lower):
                classes.append(_class_id(shingles))
                sets.append(shingles.tobytes())
                held += len(shingles)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    classes, sets, held = [], [], 0
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)
    return run


def _need(nx: Column, ny: Column, percent: int) -> Column:
    """Shingles that sets of ``nx`` and ``ny`` share at least where they reach the similarity."""
    return F.floor(((nx + ny) * percent + 99 + percent) / F.lit(100 + percent))


def _may_reach(x: str, y: str, percent: int, suffix: bool) -> Column:
    """The length, position and suffix filters for postings ``x`` and ``y`` of one shingle."""
    nx, ny, px, py = (F.col(f"{s}.{c}").cast("long") for c in ("n", "pos") for s in (x, y))
    need = _need(nx, ny, percent)
    at_most = F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1)
    fits = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (at_most >= need)
    if suffix:  # sets cut into equal parts by hash: where one part's sizes differ in parity, the sets differ
        apart = F.lit(0)
        for i in range(PARTS // 64):
            apart = apart + F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}")))
        fits = fits & (apart <= nx + ny - 2 * need)
    return fits


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _pairs_that_meet_enough(joined: DataFrame, percent: int) -> DataFrame:
    """The pairs that can reach the similarity by the number of shingles on which they meet, all of them being in ``joined``.

    Of two prefixes one ends first in the common order. A shingle of it that the sets share is in the other prefix too, so both
    meet there; all others they share are in the rest of its set. So what they share is at most what they meet on plus the longer rest.
    """
    nx, ny = (F.col(f"{s}.n").cast("long") for s in ("x", "y"))
    rest = F.ceil(F.greatest(nx, ny) * percent / F.lit(100)) - 1
    least, most = F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")
    return (joined.select(least, most, (_need(nx, ny, percent) - rest).alias("least")).groupBy("a", "b", "least").count()
            .where("count >= least").select("a", "b"))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to every executor if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _checked(pairs: DataFrame, texts: DataFrame, copies: DataFrame, n: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a written table) whose whole sets reach the similarity, as a written table.

    A pair is turned so that ``h`` is the class with more pairs: the sets of the others meet their pairs where they are made,
    and travel once, to the few sets of the hubs. Only classes of several documents (``copies``) need their sets made one first.
    """
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    needed = materialise(ends.groupBy("cls").agg(F.count("*").alias("pairs")).join(copies, "cls", "left"), "needed")
    keys = _sent(needed.select("cls", F.coalesce("several", F.lit(False)).alias("several")))
    raw = materialise(texts.mapInArrow(tidy(_sets(n, lower)), "cls long, shingles binary").join(keys, "cls"), "sets")
    one = raw.where("several").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    sets = raw.where("not several").select("cls", "shingles").unionByName(one)
    degree = needed.select("cls", "pairs")
    both = (pairs.join(_sent(degree).toDF("a", "da"), "a").join(_sent(degree).toDF("b", "db"), "b"))
    turned = materialise(both.select(F.when(F.col("da") > F.col("db"), F.col("a")).otherwise(F.col("b")).alias("h"),
                                     F.when(F.col("da") > F.col("db"), F.col("b")).otherwise(F.col("a")).alias("x")), "turned")
    central = materialise(turned.select(F.col("h").alias("cls")).distinct(), "hubs")
    hubs = sets.join(_sent(central), "cls", "left_semi")
    meet = sets.withColumnsRenamed({"cls": "x", "shingles": "set_x"}).join(_sent(turned), "x")
    both = meet.join(hubs.withColumnsRenamed({"cls": "h", "shingles": "set_h"}), "h")
    least, most = F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b")
    good = materialise(both.select(least, most, "set_h", "set_x").mapInArrow(tidy(_verify(percent)), "a long, b long"), "links")
    discard(needed, raw, turned, central)
    return good


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``class_id``, one row per row of ``docs``.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of distinct
    ``words``-word shingles (A-Z in lower case unless ``lower`` is off). ``component_id`` is the
    smallest id reachable over links. A document of fewer words has its whole sequence as its one
    shingle; null, empty and wordless texts have no class, link with nothing and are their own
    component. Rows that repeat an id are separate documents; rows without an id link, but give no
    component its name. An empty table gives no rows; columns other than these two are not read.
    """
    spark = shipped(docs.sparkSession)
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = table.select("text")
    id_type = to_arrow_type(table.schema["id"].dataType)
    shape = f"id {table.schema['id'].dataType.simpleString()}, n long, cls long, parts binary, chunk int, counts binary"
    counted = materialise(table.mapInArrow(tidy(_profile(words, lower, id_type)), shape), "counted")
    levels = spark.sparkContext.broadcast(_levels(counted))
    profile = materialise(counted.where("chunk is null").select("id", "n", "cls", "parts"), "profile")
    discard(counted)
    sizes = profile.select("id", "n", "cls")
    shape = "g long, cls long, n int, pos int"
    prefixes = texts.mapInArrow(tidy(_prefixes(words, lower, percent, levels)), shape).select("g", "cls")
    repeated = materialise(prefixes.groupBy("g").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("g"), "repeated")
    shared = spark.sparkContext.broadcast(build_filter(repeated, "g", repeated.count()))
    meeting = materialise(texts.mapInArrow(tidy(_prefixes(words, lower, percent, levels, shared)), shape).join(repeated, "g").distinct(), "meeting")
    levels.destroy()  # what follows reads written tables
    shared.destroy()
    discard(repeated)

    hubs = meeting.groupBy("g").agg(F.min(F.struct("pos", "n", "cls")).alias("h")).select("g", "h.*")
    starred = meeting.alias("x").join(hubs.alias("y"), F.expr("x.g = y.g and x.cls <> y.cls") & _may_reach("x", "y", percent, suffix=False))
    first = materialise(_pairs(starred), "pairs")
    copies = materialise(sizes.where("cls is not null").groupBy("cls").count().where("count > 1").select("cls", F.lit(True).alias("several")), "copies")
    linked = _checked(first, texts, copies, words, lower, percent)
    known = connected_components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    placed = (meeting.join(known.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("root", F.coalesce("root", "cls")))
    split = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
    parts = profile.where("cls is not null").groupBy("cls").agg(F.first("parts").alias("parts"))
    words_of = [F.conv(F.hex(F.substring("parts", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"p{i}") for i in range(PARTS // 64)]
    open_ = materialise(placed.join(split, "g").join(parts, "cls").select("g", "cls", "n", "pos", "root", *words_of), "open")
    crossing = open_.alias("x").join(open_.alias("y"), F.expr("x.g = y.g and x.root < y.root") & _may_reach("x", "y", percent, suffix=True))
    discard(meeting)
    rest = materialise(_pairs_that_meet_enough(crossing, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    discard(open_, first)
    more = _checked(rest, texts, copies, words, lower, percent)
    found = connected_components(linked.unionByName(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    discard(linked, rest, more, copies)

    member = (sizes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    member = materialise(member, "member")
    discard(profile)
    names = member.where("cls is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return (member.join(names, "root", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.col("cls").alias("class_id")))


def _verdict(unsettled: Broadcast[HashFilter], staying: Broadcast[HashFilter]):
    """Of each key's hash: 0 if its one row stays for certain, 2 if it goes for certain, 1 if a join has to tell."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for places in batches:
            places = places.to_numpy(zero_copy_only=False)
            asks, stays = unsettled.value.passes(places), staying.value.passes(places)
            yield pa.array(np.where(asks, np.where(stays, 1, 2), 0), pa.int32())

    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(batches)
    return F.arrow_udf(verdict, "int")


def keep_one_per_group(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near copies: one row of each component stays.

    It is a row with the smallest id; among rows of that id the text's hash decides, and rows without an id stay only where
    no row of their component has one. Rows without words link with nothing and stay. Rows equal in id and text, null
    included, are one document, of which one row stays. Other columns pass through. Rows that two bitmaps of bounded size settle
    are kept or left out where they are read; the others, most of them repeated rows that stay, are shuffled with all columns.
    """
    spark = docs.sparkSession
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k1"),
                   F.xxhash64(F.lit(1), text_col).alias("k2"), F.col(text_col).isNull().alias("empty"))
    groups = jaccard_components(docs.select(row.alias("key"), F.col(text_col).alias("text")), words, percent, lower, "key", "text")
    stays = F.bool_or(F.col("key").eqNullSafe(F.col("component_id"))).alias("stays")
    judged = materialise(groups.groupBy("key").agg(stays, F.count("*").alias("rows")).withColumn("place", F.xxhash64("key")), "judged")
    filters = []
    for rows in (judged.where("not stays or rows > 1"), judged.where("stays")):
        filters.append(spark.sparkContext.broadcast(build_filter(rows, "place", rows.count())))
    verdict = _verdict(*filters)
    stay = judged.where("stays").where(verdict("place") == 1).select(F.col("key").alias("__stay"))
    keyed = docs.withColumn("__key", row).withColumn("__verdict", verdict(F.xxhash64("__key")))
    asked = keyed.where("__verdict = 1").join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"])
    return keyed.where("__verdict = 0").unionByName(asked).drop("__key", "__verdict")
