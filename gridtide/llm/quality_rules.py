"""Quality rules and cross-document line frequency, in DataFrame functions only.

A line that many documents of one host share is boilerplate. Lines are normalised and hashed, distinct
documents counted per host and line (a row per line and task reaches the shuffle, however common a line
is), lines above the limit removed, and documents that lose most of their words rejected.
Run hashes have 64 bits: two different runs of one text share one with probability about n*n/2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.session import materialise

SEPARATORS = " \t\n\x0b\f\r"
BROADCAST_ROWS = 200_000  # frequent lines (24 bytes) sent to every executor at most; beyond, a shuffled join
MIN_WORDS = 50
MIN_DOCS = 10             # a line in so many documents of its host or fewer stays, however large the host
RUN = 3


def words_of(text: Column) -> Column:
    """Words of a text that is not null: runs of other characters than space and 0x09-0x0D."""
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def line_key(line: Column) -> Column:
    """The hash of a line in lower case with single spaces."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(SEPARATORS)), "[ \\t-\\r]+", " ")))


def _tail(items: Column, n: int = 1) -> Column:
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def _covered(places: Column) -> Column:
    """How many words runs at these sorted places cover together."""
    steps = F.zip_with(places, _tail(places), lambda a, b: F.least(F.coalesce(b - a, F.lit(RUN)), F.lit(RUN)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def text_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``.

    ``n_dup_lines`` counts lines with a word that equal an earlier line, ``n_repeat_words`` the words in
    runs of three that occur twice or more in the text. Null, empty and wordless texts have zeros and fail.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumns({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")})
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    pairs = F.zip_with("_hashes", _tail(F.col("_hashes")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.zip_with(pairs, _tail(F.col("_hashes"), 2), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    step = step.withColumn("_runs", F.slice(runs, 1, F.greatest(F.size("_hashes") - 2, F.lit(0))))
    placed = F.sort_array(F.transform("_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.withColumn("_placed", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), placed))
    same = F.zip_with("_placed", _tail(F.col("_placed")), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    step = step.withColumn("_places", F.when(F.col("_placed").isNotNull(), places))
    n_words = F.size("_words").cast("long")
    repeat = F.when(F.col("_places").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_places")))
    return step.withColumns({
        "n_words": n_words,
        "word_chars": F.length(F.translate(text, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat,
    }).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop(
        "_words", "_hashes", "_runs", "_placed", "_places")


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                   min_docs: int = MIN_DOCS, min_share: float | None = None) -> DataFrame:
    """A written table of ``host, line, n_docs``: normalised lines in more documents of their host than the limit.

    The limit is ``min_docs`` at every size of a host; with ``min_share`` it is that share of the host's documents
    where this is more. Rows are documents; a null host is a host of its own.
    """
    host = F.col(host_col).alias("host")
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    keys = docs.select(host, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("line"))
    counted = keys.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    if min_share is not None:
        hosts = docs.groupBy(host).agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "of")
        counted = counted.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > min_share * F.col("host_docs"))
    return materialise(counted.select("host", "line", "n_docs"), "lines")


def line_frequency_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                         min_docs: int = MIN_DOCS, min_share: float | None = None) -> DataFrame:
    """``id_col``, the columns of ``text_rules``, ``removed_lines``, ``n_words_left``, ``depleted`` and ``kept``, one row per row.

    ``removed_lines`` are the places (from 0, among the lines with a word) of lines above the limit of
    ``frequent_lines``. A document is depleted when less than half of its words are left. ``kept`` means
    neither base_failed nor depleted. Repeated rows and rows without an id are documents of their own; null
    texts have no lines; an empty table gives no rows; other columns are not read.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    frequent = frequent_lines(table, "host", "text", min_docs, min_share).select(F.col("host").alias("of"), "line")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    base = text_rules(table).withColumn("_row", F.monotonically_increasing_id()).drop("text")
    rows = base.select("*", F.posexplode_outer("_lines").alias("place", "text_line")).drop("_lines")
    rows = rows.withColumn("key", line_key(F.col("text_line")))
    hit = rows.join(frequent.withColumn("hit", F.lit(True)), F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("line")), "left")
    keys = ["_row", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    lost = F.coalesce(F.sum(F.when(F.col("hit"), F.size(words_of(F.col("text_line"))))), F.lit(0))
    done = hit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("place")))).alias("removed_lines"),
                                  (F.first("n_words", True) - lost).alias("n_words_left"))
    done = done.withColumn("depleted", 2 * F.col("n_words_left") < F.col("n_words"))
    return done.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).withColumnRenamed("id", id_col).drop("_row")


def drop_lines(text: Column, removed: Column) -> Column:
    """A text's lines with a word but for those at the removed places."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")
