"""Encoding against the libraries, packing against its rules and the lower bound."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brute import ordered
from gridtide.llm import best_fit_packing as packing
from gridtide.llm import sentencepiece_codec as codec
from gridtide.llm import textkit

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_encode_and_decode_as_the_library(corpus, plain):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = codec.encode(corpus, PIECES, decoded_col="decoded")
    got = coded.collect()
    other = codec.decode(coded.drop("decoded"), PIECES).collect()
    assert ordered((r["doc_id"], r["decoded"]) for r in got) == ordered((r["doc_id"], r["decoded"]) for r in other)
    want = [(i, library.encode(t or "")) for i, t, *_ in plain]
    assert ordered((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got) == ordered((i, ids, library.decode(ids)) for i, ids in want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é▁ \n\t\r.;}0日😀　 <s>"), max_size=40))
def test_chunks_segment_alone(text):
    library = codec._processor(codec.read_model(PIECES))
    parts = codec.chunks(text)
    assert [i for ids in (codec._chunk_ids(library, parts) if parts else []) for i in ids] == library.encode(text)


def test_encode_empty_table(corpus):
    assert codec.decode(codec.encode(corpus.limit(0), PIECES), PIECES).count() == 0


def test_lists_of_any_characters_round_trip():
    items = ["", "a\u0000b", "é", "x" * 1000]
    assert codec._split(codec._join(items)) == items


def test_pieces_hold_the_ids_of_the_library(corpus, plain):
    library = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text, *_ in plain:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            length = first if piece == 0 else 1024
            want.append((doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())))
    rows = packing.pack_documents(corpus, BYTES).collect()
    assert ordered(tuple(r)[:5] for r in rows) == ordered(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 4


def test_pack_empty_table(corpus):
    assert packing.pack_documents(corpus.limit(0), BYTES).count() == 0


def test_very_long_blank_run_has_the_library_ids():
    text = "a" + " " * 300_000 + "b"
    fast = packing._ids(text, packing._encoders(packing.read_tokenizer(BYTES)))
    assert fast.tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_fullest_combination_is_the_best_there_is(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(8)}
    room = rng.randint(10, 120)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    chosen = packing._fullest(counts, room)
    assert sum(x * n for x, n in chosen.items()) == max(sums)
    assert all(n <= counts[x] for x, n in chosen.items())


def test_plan_places_every_rank_once_and_stays_small():
    rng = random.Random(1)
    counts = {i: rng.randint(1, 10**9) for i in range(1, 1025)}
    plan = packing.plan_bins(counts, 1024)
    assert plan.bins <= 1.02 * sum(k * v for k, v in counts.items()) / 1024 + 1
    assert len(plan.length) < 50_000
    for length in (1, 500, 1024):
        rows = np.flatnonzero(plan.length == length)
        assert plan.rank[rows[0]] == 0 and (np.diff(plan.rank[rows]) > 0).all()


def test_pack_rejects_impossible_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long"))


def test_a_worker_holds_the_model_of_one_stage():
    @functools.lru_cache(maxsize=2)
    def build(name):
        return [name]

    first = build("m")
    textkit.hold_only(build)
    textkit.hold_only(build)
    assert build("m") is first  # the stage's next task
    assert list(textkit.tidy(iter)([1, 2])) == [1, 2]
    assert build.cache_info().currsize == 0 and build("m") is not first
