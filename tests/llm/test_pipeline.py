"""Every stage on what the one before kept, with edge rows and an empty table."""

import collections
import os
import zlib
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from brute import ordered
from test_duplicates import brute_strip, one_of_each
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gridtide.llm.language_id import learn_languages, predict_language
from gridtide.llm.quality_ranking import learn_quality, score_quality
from gridtide.session import checkpoint_root, materialise


@pytest.fixture(scope="module")
def chain(spark, sf, corpus):
    docs = corpus.select("doc_id", "text", "lang", "source", "score", "row").selectExpr("*", "cast(length(text) as long) as n_chars")
    steps = [materialise(docs)]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], sf), name))
    return steps


def test_columns_stay_until_the_last_stage(chain):
    assert all(step.columns == chain[0].columns for step in chain[1:-1])
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(chain[-1].columns)


def test_rejections_take_effect(chain):
    counts = [step.count() for step in chain[:-1]]
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0
    texts = [r[0] for r in chain[3].select("text").where("text is not null").collect()]
    assert len(texts) == len(set(texts))
    judged = {r[0] for r in chain[2].select("doc_id").collect()}
    assert 100_001 not in judged and 100_013 not in judged  # no letters


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_judges_drop_what_they_reject_and_nothing_else(chain, spark, sf):
    ranking = learn_quality(chain[0].select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    scored = score_quality(chain[0].select("doc_id", "text"), ranking).collect()
    assert ordered(rows_of(chain[1])) == ordered((r["doc_id"], r["text"]) for r in scored if r["score"] >= 0.3)
    network = learn_languages(chain[1].select("doc_id", "text", "lang"))
    told = predict_language(chain[1].select("doc_id", "text"), network).collect()
    assert ordered(rows_of(chain[2])) == ordered(
        (r["doc_id"], r["text"]) for r in told if any(c.isalpha() for c in r["text"] or "") and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE)


def test_one_document_of_each_group_stays(chain):
    before, after = rows_of(chain[2]), rows_of(chain[3])
    assert not collections.Counter(after) - collections.Counter(before)
    assert sorted((i is None, i or 0) for i, _ in after) == one_of_each(before, 5, 80)


def test_repeated_passages_go(chain):
    before = rows_of(chain[3])
    want = [(i, kept if removed else text) for (i, text), (_, _, removed, kept) in zip(before, brute_strip(before, corpus_pipeline.PASSAGE_WORDS))]
    assert ordered(rows_of(chain[4])) == ordered(want)


def test_pieces_are_those_of_the_library_without_gaps(chain):
    library, want, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], collections.defaultdict(list)
    for doc_id, text in rows_of(chain[4]):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for start in [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]:
            end = (len(ids) - 1) % 1024 + 1 if start == 0 else start + 1024
            want.append((doc_id, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    got = chain[5].collect()
    assert ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ordered(want)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024


def test_every_document_left_is_packed(chain):
    assert ({r[0] for r in chain[4].select("doc_id").collect()} == {r[0] for r in chain[5].select("doc_id").collect()})


def test_empty_documents(spark, sf, corpus):
    docs = corpus.select("doc_id", "text", "lang", "source").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        assert docs.count() == 0
        docs = corpus.select("doc_id", "text", "lang", "source").limit(0)


def test_only_the_last_written_stage_stays(spark, sf, monkeypatch):
    folder = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(folder))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: docs) for name, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["fm_substring"]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
