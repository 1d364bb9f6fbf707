"""The registered queries of this subpackage, each over a whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.llm.best_fit_packing import pack_documents
from gridtide.llm.embedding_dedup import near_vectors
from gridtide.llm.hard_negatives import hard_negatives
from gridtide.llm.jaccard_join import jaccard_components
from gridtide.llm.language_id import learn_languages, predict_language
from gridtide.llm.license_scan import licence_sql, scan_licences
from gridtide.llm.periodic_runs import periodic_runs
from gridtide.llm.quality_ranking import learn_quality, score_quality
from gridtide.llm.quality_rules import line_frequency_rules
from gridtide.llm.sentencepiece_codec import encode
from gridtide.llm.substring_dedup import remove_repeats
from gridtide.llm.topk_search import top_products
from gridtide.llm.url_filter import judge_urls, learn_urls, with_rules

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def documents(spark, sf, *columns):
    return spark.read.parquet(f"{sf}/documents.parquet").select(*columns)


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf):
    """Groups of documents over links of 4-word shingle sets with similarity 0.85 or more."""
    return jaccard_components(documents(spark, sf, "doc_id", "text"), words=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf):
    """Ids of every whole text and the text they decode to, as digests."""
    import public_tokenizers

    coded = encode(documents(spark, sf, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded_col="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op5_min_bin_slack")
def op5_min_bin_slack(spark, sf):
    """Every document's pieces of at most 1024 tokens in as few sequences as the method finds."""
    import public_tokenizers

    packed = pack_documents(documents(spark, sf, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_fm_substring")
def op9_fm_substring(spark, sf):
    """Every document without the words that repeated runs of 35 words cover."""
    stripped = remove_repeats(documents(spark, sf, "doc_id", "text"), window=35)
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def id_checksum(name: str = "doc_id"):
    """crc32 of the id as text, the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


@query("op3_byte_language")
def op3_byte_language(spark, sf):
    """The language of every whole text, learned without the held-out third."""
    docs = documents(spark, sf, "doc_id", "text", "lang").withColumn("held_out", id_checksum() % 3 == 1)
    network = learn_languages(docs.where(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), network).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_quality_ranking")
def op4_quality_ranking(spark, sf):
    """Quality of every whole text, learned without the held-out fifth."""
    docs = documents(spark, sf, "doc_id", "text").withColumn("held_out", id_checksum() % 5 == 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").where(id_checksum() % 5 != 0)
    ranking = learn_quality(docs.where(~F.col("held_out")), labels)
    return score_quality(docs, ranking).select("doc_id", "held_out", "score", "predicted")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM p),
again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
k AS (SELECT rid, source, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
             lower(array_to_string(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ')) AS norm FROM l),
many AS (SELECT source, norm FROM k
         GROUP BY source, norm HAVING count(DISTINCT rid) > 10),
lost AS (SELECT rid, sum(n) AS n FROM k JOIN many m ON k.source IS NOT DISTINCT FROM m.source AND k.norm = m.norm GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - lost) >= n_words AS kept
FROM base
"""


@query("op7_line_frequency", OP7_SQL)
def op7_line_frequency(spark, sf):
    """Counts per document and the verdict of the line rules."""
    return line_frequency_rules(documents(spark, sf, "doc_id", "source", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URL_MARKS = ("adult", "ads", "bets", "casino", "pills", "spam")  # host words that label a URL as blocked for learning


def labelled_urls(pages):
    """URLs with the verdict of their rule, else blocked if a word of the host is marked."""
    ruled = with_rules(pages, URL_RULES)
    marked = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, URL_MARKS)))
    blocks = [rule for verdict, rule in URL_RULES if verdict == "block"]
    return ruled.withColumn("blocked", F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks)).otherwise(marked))


@query("op6_url_trees")
def op6_url_trees(spark, sf):
    """Host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, learn_urls(labelled_urls(pages)), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op8_pivot_vectors")
def op8_pivot_vectors(spark, sf):
    """Direct links and groups of all embeddings of a label."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_vectors(vectors, 0.98)


@query("op10_license_sentences", licence_sql("documents", "doc_id"))
def op10_license_sentences(spark, sf):
    """Known licence sentences and licences of every whole text."""
    return scan_licences(documents(spark, sf, "doc_id", "text")).drop("text")


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.uid AS other,
             CAST(list_inner_product(CAST(a.c AS DOUBLE[]), CAST(b.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid AND len(a.c) = len(b.c)),
p AS (SELECT uid, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) <= 5),
n AS (SELECT p.uid, p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS rank
      FROM p JOIN s ON p.uid = s.uid AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_shared_list_negatives", OP11_SQL)
def op11_shared_list_negatives(spark, sf):
    """Hard negatives of every hundredth vector, after moving every seventh label on by one."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, b.uid AS other,
             CAST(list_inner_product(CAST(a.c AS DOUBLE[]), CAST(b.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.uid <> b.uid AND len(a.c) = len(b.c)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


@query("op12_branch_and_bound", OP12_SQL)
def op12_branch_and_bound(spark, sf):
    """The 20 highest inner products of every twentieth vector."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(table, F.col("vec_id") % 20 == 0, k=20, scale=64)


def with_loop(docs, id_col: str = "doc_id"):
    """Texts of every tenth id, by checksum, whose words repeat from some word on; a null id changes nothing."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    told = docs.withColumns({"_h": F.crc32(F.col(id_col).cast("string").cast("binary")), "_w": F.lit(None).cast("array<string>")})
    told = told.withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    told = told.withColumn("_n", F.size("_w")).withColumn("_g", F.floor(F.col("_h") / 10))
    told = told.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    told = told.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(
        F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    looped = F.array_join(F.transform(at, lambda i: F.get(F.col("_w"), i.cast("int"))), " ")
    return told.withColumn("text", F.when(F.col("_n") > 0, looped).otherwise(F.col("text"))).drop("_h", "_w", "_n", "_g", "_a", "_p")


@query("op13_recompressed_runs")
def op13_recompressed_runs(spark, sf):
    """Periodic runs of the words of every whole text, and the text without their repeats, as digests."""
    found = periodic_runs(with_loop(documents(spark, sf, "doc_id", "text")), least=24, times=3)
    return found.select("doc_id", *run_digests())


def run_digests():
    """Columns of the runs: their number, the one of greatest exact exponent, and digests."""
    more = lambda a, b: a["length"].cast("decimal(38,0)") * b["period"] - b["length"].cast("decimal(38,0)") * a["period"]
    by_exponent = F.array_sort("runs", lambda a, b: F.when(more(a, b) != 0, F.when(more(a, b) > 0, -1).otherwise(1))
                               .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                               .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0))
    top = F.get(by_exponent, 0)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    milli = (1000 * top["length"] - F.pmod(1000 * top["length"], top["period"])) / top["period"]  # a whole number
    return [F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
            milli.cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed_text", 256).alias("collapsed_sha256")]
