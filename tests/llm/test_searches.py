"""Searches over vectors and runs of words against brute force."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import ordered, words
from pyspark.sql import functions as F

from gridtide.llm import hard_negatives as hard
from gridtide.llm import periodic_runs as periodic
from gridtide.llm import topk_search as topk
from gridtide.llm import vector_grid as grid
from gridtide.llm.queries import run_digests, with_loop


def floors(vector, scale):
    """Whole components, or None for a vector that takes no part."""
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(Fraction(x) * scale) for x in vector]


def pairs(rows, scale):
    """(own place, other place, score) of rows of equal length."""
    whole = [floors(r[1], scale) for r in rows]
    for i, a in enumerate(whole):
        for j, b in enumerate(whole):
            if i != j and a and b and len(a) == len(b):
                yield i, j, sum(x * y for x, y in zip(a, b))


def last(i):
    return (i is None, i)


def brute_top(rows, asks, k, scale):
    of = {}
    for i, j, score in pairs(rows, scale):
        if asks(rows[i][0]):
            of.setdefault(i, []).append((-score, last(rows[j][0]), j))
    return [(rows[i][0], rank, rows[j][0], -s) for i, near in of.items() for rank, (s, _, j) in enumerate(sorted(near)[:k], 1)]


def brute_hard(rows, asks, k, percent, scale):
    rows, near, out = [r for r in rows if r[2] is not None], {}, []
    for i, j, score in pairs(rows, scale):
        if asks(rows[i][0]):
            near.setdefault((i, rows[i][2] == rows[j][2]), []).append((-score, last(rows[j][0]), j))
    for i in {i for i, _ in near}:
        for s, _, j in sorted(near.get((i, True), []))[:k]:
            good = [x for x in sorted(near.get((i, False), [])) if percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(rows[i][0], rows[j][0], rank, rows[n][0], -s, -x) for rank, (x, _, n) in enumerate(good, 1)]
    return out


def vectors(seed, n=150, dims=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:  # copies and near copies: ties
            base = [x if x is not None and math.isfinite(x) else 0.0 for x in (rng.choice(rows)[1] or [])] or [0.1] * dims
            vector = base if kind < 0.15 else [x + rng.uniform(-0.01, 0.01) for x in base]
        else:
            vector = [rng.gauss(0, 0.4) for _ in range(dims)]
        rows.append((i, vector, rng.randrange(3)))
    rows += [(0, rows[0][1], 0), (20, [0.0] * dims, 1), (200, None, 1), (220, [], 1), (240, [None] + [0.5] * (dims - 1), 1),
             (260, [float("nan")] * dims, 2), (280, [float("inf")] * dims, 2), (None, rows[3][1], 1), (300, [0.5] * 3, 0),
             (320, [0.25] * 3, 1), (340, rows[4][1], None), (None, rows[3][1], 1), (360, [-0.5] * 3, 0)]
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(grid, "CELLS", 300)
    monkeypatch.setattr(grid, "PACK_CELLS", 60)
    monkeypatch.setattr(hard, "FIRST", 4)
    monkeypatch.setattr(hard, "MEMBERS", 3)


SHAPE = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 20)])
def test_top_products(spark, small_blocks, seed, k):
    rows = vectors(seed)
    table = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'own' AS uid", "1 AS block", "2 AS rank", "3 AS score")
    got = topk.top_products(table, F.col("vec_id") % 20 == 0, k).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_top(rows, lambda i: i is not None and i % 20 == 0, k, 64))


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, small_blocks, seed):
    rows = vectors(seed)
    table = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'own' AS uid", "1 AS cluster", "2 AS caps", "3 AS floors")
    got = hard.hard_negatives(table, F.col("vec_id") % 20 == 0).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_hard(rows, lambda i: i is not None and i % 20 == 0, 5, 80, 256))


def test_one_block_and_whole_queries(spark):
    rows = vectors(5)
    table = spark.createDataFrame(rows, SHAPE)
    every = lambda i: i is not None
    assert ordered(tuple(r) for r in topk.top_products(table, F.col("vec_id").isNotNull(), 4).collect()) == ordered(brute_top(rows, every, 4, 64))
    got = hard.hard_negatives(table, F.col("vec_id").isNotNull()).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_hard(rows, every, 5, 80, 256))


@pytest.mark.parametrize("scale", [1e5, 3e6])
def test_scores_beyond_double_precision_are_exact(spark, scale):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(3)], i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, SHAPE)
    got = topk.top_products(table, F.col("vec_id") % 20 == 0, 5, scale=256).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_top(rows, lambda i: i % 20 == 0, 5, 256))
    found = hard.hard_negatives(table, F.col("vec_id") % 20 == 0).collect()
    assert ordered(tuple(r) for r in found) == ordered(brute_hard(rows, lambda i: i % 20 == 0, 5, 80, 256))


def test_huge_components_saturate(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [1e300, 0.0], 0), (2, [-1e300, 0.0], 1), (3, [1.0, 1.0], 1)]
    got = topk.top_products(spark.createDataFrame(rows, SHAPE), F.col("vec_id") == 0, 3).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2]


@pytest.mark.parametrize("search", [lambda t, a: topk.top_products(t, a), lambda t, a: hard.hard_negatives(t, a)])
def test_empty_tables_and_no_queries(spark, search):
    empty = spark.createDataFrame([], SHAPE)
    assert search(empty, F.col("vec_id") >= 0).collect() == []
    assert search(spark.createDataFrame(vectors(1), SHAPE), F.col("vec_id") < 0).collect() == []


def test_bounds_hold_and_prune():
    """No candidate of the best is compacted away, and near ones leave most of the others behind early."""
    rng = np.random.default_rng(3)
    rows = np.floor(64 * rng.normal(0, 0.1, (500, 40)))
    rows[:30] = rows[0] + rng.integers(-1, 2, (30, 40))
    for i in (0, 40):
        scores = rows @ rows[i]
        want = set(np.argsort(-scores, kind="stable")[:10].tolist())
        at, found = topk.survivors(rows[i], np.ascontiguousarray(rows.T), (rows * rows).sum(axis=1), np.arange(500), 10, -1e18)
        assert want <= set(at.tolist()) and (found == scores[at]).all()
    assert len(topk.survivors(rows[0], np.ascontiguousarray(rows.T), (rows * rows).sum(axis=1), np.arange(500), 10, -1e18)[0]) < 60


def test_shared_list_bounds_every_member():
    rng = np.random.default_rng(4)
    members, rows = rng.integers(-40, 40, (9, 8)), rng.integers(-40, 40, (200, 8))
    order, bound = hard.shared_list(members, rows)
    reach = bound[None] * grid.norms(members)[:, None] * (1 + 1e-9)
    assert (members @ rows[order].T <= reach).all() and (np.diff(bound) <= 0).all()


@pytest.mark.parametrize("cap", [-11, -10, -1, 0, 1, 7, 10, 12345])
def test_least_share(cap):
    assert hard.least_of(np.array([cap]), 80)[0] == math.ceil(Fraction(80 * cap, 100))


def brute_runs(w, least, times):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic, "ASKED", rng.choice([8, 64, 1 << 20]))
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            letters, n = rng.choice([1, 2, 3, 5, 20]), rng.randrange(0, 120)
            w = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.6 and n > 10:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(2, 9)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        least, times = rng.choice([(24, 3), (6, 3), (4, 2), (10, 2)])
        got = periodic.runs_of([np.array(w, np.int64) for w in texts], least, times)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(w, least, times) for w in texts]


def test_grammar_spells_the_text_and_is_flat():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([[90], rng.integers(0, 3, 4000), np.full(3000, 2), [91]])
    levels = periodic.recompress(symbols)
    assert len(levels) < 80 and len(levels[-1].names) == 1
    for level, above in zip(levels, levels[1:]):
        assert (level.names == above.symbols).all() and (np.diff(level.first) > 0).all()
    for level in levels:  # a name stands for one sequence of symbols
        spelled = {}
        for name, lo, hi in zip(level.names.tolist(), level.first[:-1], level.first[1:]):
            assert spelled.setdefault(name, level.symbols[lo:hi].tolist()) == level.symbols[lo:hi].tolist()


def test_agreement_both_ways():
    rng = np.random.default_rng(2)
    body = np.tile(rng.integers(0, 2, 37), 12)
    body[200] = 5
    symbols = np.concatenate([[90], body, [91]])
    levels = periodic.recompress(symbols)
    a, b = rng.integers(1, len(body) + 1, 500), rng.integers(1, len(body) + 1, 500)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    for onward in (True, False):
        got = periodic.agreement(levels, a, b, onward)
        for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
            step, m = (1 if onward else -1), 0
            while symbols[x + step * m] == symbols[y + step * m]:
                m += 1
            assert n == m


def looped(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    w = looped(doc_id, text)
    runs = brute_runs(w, 24, 3) if len(w) < 3000 else None
    if runs is None:
        return None
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(corpus, plain, spark, monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 64)
    made = [(900_000 + i, " ".join(random.Random(i).choices(["a", "b", "cc"], k=i * 3)) + " z" * (i % 40)) for i in range(60)]
    docs = corpus.select("doc_id", "text", "score", "length").unionByName(
        spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'own' AS score", "'own' AS length"))
    got = periodic.periodic_runs(with_loop(docs)).select("doc_id", *run_digests()).collect()
    want = [(r, brute_digest(*r[:2])) for r in [*[p[:2] for p in plain], *made]]
    short = {tuple(x) for x in got if x["doc_id"] not in {r[0] for r, b in want if b is None}}
    assert short == {b for _, b in want if b is not None}
    assert len(got) == len(want) and sum(r["n_runs"] for r in got) > 20


def test_a_very_long_text(spark):
    """A run through a long text, and unlike words all the way: no more places asked than a few per word."""
    n = 200_000
    unlike = " ".join(f"w{i}" for i in range(n))
    rows = [(1, " ".join(f"w{i % 50_000}" for i in range(n))), (2, unlike), (3, "x " * n)]
    got = {r["id"]: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, n, 50_000)] and got[1]["collapsed_text"] == " ".join(f"w{i}" for i in range(50_000))
    assert got[2]["runs"] == [] and got[2]["collapsed_text"] == unlike
    assert [tuple(r) for r in got[3]["runs"]] == [(0, n, 1)] and got[3]["collapsed_text"] == "x"


def test_runs_of_an_empty_table(corpus):
    got = periodic.periodic_runs(corpus.limit(0))
    assert got.count() == 0 and {"n_words", "runs", "collapsed_text"} <= set(got.columns)
