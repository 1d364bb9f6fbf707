"""The training-corpus pipeline: every stage works on what the one before kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame that is written as Parquet and read again. All but
the last return the columns of ``docs``. Rows with null or empty text go in the first stage that judges texts
(language, if quality keeps them); repeated rows leave one; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.best_fit_packing import pack_documents
from gridtide.llm.jaccard_join import keep_one_per_group
from gridtide.llm.language_id import UNKNOWN, learn_languages, predict_language
from gridtide.llm.quality_ranking import learn_quality, score_quality
from gridtide.llm.substring_dedup import remove_repeats
from gridtide.session import discard, materialise

LEAST_LANGUAGE_SCORE = 0.3  # pooled probability of the language
PASSAGE_WORDS = 50          # a passage of so many words that repeats goes


def _boxed(docs: DataFrame) -> DataFrame:
    """The text and all other columns as one, so that no operator's new column can clash."""
    return docs.select("text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("row"))


def _unboxed(boxed: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    back = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns} | changed
    return boxed.select(*[back[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from ``labels`` puts above its cut."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    ranking = learn_quality(docs.select("doc_id", "text"), labels)
    return _unboxed(score_quality(_boxed(docs), ranking).where("predicted = 1"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from ``lang``; all of them if none is given there."""
    network = learn_languages(docs.select("doc_id", "text", "lang"))
    if not network.labels:
        return docs
    judged = predict_language(_boxed(docs), network)
    return _unboxed(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return keep_one_per_group(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE_WORDS`` words that repeat; texts that lose nothing stay as they are."""
    stripped = remove_repeats(_boxed(docs), PASSAGE_WORDS)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return _unboxed(stripped, docs, **changed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_ranking", quality), ("byte_language", language), ("ngram_jaccard", near_duplicates),
          ("fm_substring", repeated_passages), ("min_bin_slack", packing)]
ORACLE_SQL = None  # learned scores and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
