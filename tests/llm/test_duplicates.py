"""Joins, components and repeats against brute force."""

import collections
import os
import random
import time
from urllib.parse import urlparse

import numpy as np
import pytest
from brute import ordered, words
from pyspark.sql import functions as F

from gridtide.llm import jaccard_join
from gridtide.llm import substring_dedup as substring
from gridtide.llm.components import connected_components
from gridtide.llm.embedding_dedup import near_vectors
from gridtide.llm.jaccard_join import jaccard_components, keep_one_per_group
from gridtide.session import checkpoint_root, discard, materialise


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_jaccard(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = groups(len(rows), near)
    names = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[of[i]].append(doc_id)
    return [(d, len(s), min(names[of[i]]) if s and names[of[i]] else (d if not s else None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_components(corpus, plain, n, percent):
    got = jaccard_components(corpus, n, percent).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(brute_jaccard([r[:2] for r in plain], n, percent))


def test_chains_and_border_similarity(spark):
    """Copies that differ step by step, and an original whose copies do not link with each other."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(110)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        edited = list(base)
        edited[rng.randrange(4, 100)] = f"edit{i}"
        rows.append((i, " ".join(edited)))
    for i in range(40, 60):
        step = list(base)
        step[5:5 + 3 * (i - 39)] = [f"n{k}" for k in range(3 * (i - 39))]
        rows.append((i, " ".join(step)))
    for words_, percent in ((4, 85), (5, 80), (4, 93)):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words_, percent).collect()
        assert ordered((r[0], r[1], r[2]) for r in got) == ordered(brute_jaccard(rows, words_, percent))


def test_jaccard_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert ordered((r[0], r[1], r[2]) for r in jaccard_components(blank).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def one_of_each(rows, n, percent):
    """(id, whether it is the only row of that id and text) of what should stay: per component the smallest id, named rows first."""
    sets = [shingles(t, n) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of, groups_ = groups(len(rows), near), collections.defaultdict(set)
    for i, row in enumerate(rows):
        groups_[of[i] if sets[i] else row].add(row)
    return sorted(min((r[0] is None, r[0] or 0) for r in found) for found in groups_.values())


def test_one_of_each_group_stays(corpus, plain, spark):
    kept = keep_one_per_group(corpus)
    assert kept.columns == [c for c in corpus.columns]
    ids = sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect())
    assert ids == one_of_each([r[:2] for r in plain], 5, 80)
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"x{i}" for i in range(30))
    rows = [(3, text), (None, text), (None, text), (7, text), (7, other), (7, other + " more"), (None, "alone here"), (None, None), (9, None)]
    got = keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == one_of_each(rows, 5, 80) and len(got) == 5


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in found if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files_and_can_go(spark):
    before = shuffle_files(spark)
    counts = spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    table = materialise(counts, "counts")
    for _ in range(100):  # files go a moment later
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    path = urlparse(table.inputFiles()[0]).path
    discard(counts, table)
    assert counts.count() == 10 and not os.path.exists(os.path.dirname(path))


def test_near_copies_leave_only_the_tables_their_result_reads(spark, corpus):
    folder = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(folder))
    kept = keep_one_per_group(corpus)
    left = sorted(name.split("-")[0] for name in set(os.listdir(folder)) - before)
    assert left == ["judged", "member", "stars", "stars"] and kept.count()


def test_texts_that_stay_alone_are_not_shuffled(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(400)) for _ in range(300)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(1000, texts[0]), (1001, texts[1] + " more"), (2, texts[2]), (2, texts[2]), (None, None), (5, None)]
    kept = keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    before = shuffle_files(spark)
    got = [r["doc_id"] for r in kept.collect()]
    assert collections.Counter(got) == collections.Counter([*range(300), None, 5])
    assert sum(os.path.getsize(f) for f in shuffle_files(spark) - before if os.path.exists(f)) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("most", [None, 0])
def test_pairs_that_meet_on_few_shingles_are_not_verified(spark, most, monkeypatch):
    """Long texts that share a fifteenth, in an order without frequencies, among near copies at the border and beyond it."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(110)]
    rows = []
    for i in range(24):
        own = [f"d{i}x{k}" for k in range(1400 + 11 * i)]
        rows.append((i, own[:9 * i] + shared + own[9 * i:]))
    for i, edits in enumerate([10, 25, 29, 30, 31, 32, 33, 40]):  # an edit takes five shingles
        copy = list(rows[i][1])
        for at in rng.sample(range(5, len(copy) - 5, 5), edits * len(copy) // 1500):
            copy[at] = f"e{i}x{at}"
        rows.append((100 + i, copy))
    for i, n in enumerate([300, 330, 350, 360]):  # and shorter ones
        rows.append((200 + i, rows[10 + i][1][n:]))
    rows = [(i, " ".join(w)) for i, w in rows]
    counts, checked = [], jaccard_join._checked
    monkeypatch.setattr(jaccard_join, "_checked", lambda pairs, *rest: counts.append(pairs.count()) or checked(pairs, *rest))
    monkeypatch.setattr(jaccard_join, "_levels", lambda profile: np.zeros((2, jaccard_join.COUNTERS), np.uint8))
    if most is not None:
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_jaccard(rows, 5, 80)
    assert ordered((r[0], r[1], r[2]) for r in got) == ordered(want)
    assert 24 < len({r[2] for r in want}) < len(rows)  # some link, some do not
    assert counts[1] < 10


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (7, 7), (None, 4), (500, 100)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3], 1), **dict.fromkeys([*range(100, 161), 500], 100)}


def brute_strip(rows, window):
    times = collections.Counter()
    for _, text in rows:
        w = words(text)
        times.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out.append((doc_id, len(w), len(w) - len(left), " ".join(left)))
    return out


@pytest.mark.parametrize("window, hot", [(35, None), (50, None), (5, None), (35, 0)])
def test_repeated_words_go(corpus, plain, window, hot, monkeypatch):
    if hot is not None:
        monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)  # every anchor dealt window by window
    got = substring.remove_repeats(corpus, window)
    assert set(corpus.columns) <= set(got.columns)
    rows = got.select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert ordered(tuple(r) for r in rows) == ordered(brute_strip([r[:2] for r in plain], window))


@pytest.mark.parametrize("most", [None, 3])
def test_a_passage_with_many_surroundings_fills_no_shard(spark, most, monkeypatch):
    """One passage in 300 texts, each with words and breaks of its own around it."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20)]) + " " + ("\n" if i % 2 else " ").join(passage) + f" b{i} " + " ".join(f"c{i}x{k}" for k in range(20)))
            for i in range(300)]
    rows += [(1000 + i, " ".join([f"d{i}x{k}" for k in range(9)] + passage[10:50])) for i in range(5)]
    monkeypatch.setattr(substring, "HOT_SEGMENTS", 20)
    if most:
        monkeypatch.setattr(substring, "BROADCAST_BYTES", most * substring.ROW_BYTES)
    match = substring._match

    def counted(window):
        inner = match(window)

        def run(table):
            assert table.num_rows < 100, f"{table.num_rows} rows in one shard"
            return inner(table)
        return run
    monkeypatch.setattr(substring, "_match", counted)
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    assert ordered(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == ordered(brute_strip(rows, 35))


def test_repeats_of_an_empty_table(corpus):
    assert substring.remove_repeats(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_index_counts_patterns(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 5, 300)
    text[-1] = 0
    index = substring.FMIndex(text.astype(np.int64), 16)
    for _ in range(60):
        at, n = rng.integers(0, 280), rng.integers(1, 12)
        pattern = text[at:at + n]
        if not pattern.all():
            continue
        lo, hi = np.array([0]), np.array([index.size])
        for symbol in pattern[::-1]:
            lo, hi = index.extend(np.array([symbol]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i:i + n] == pattern).all() for i in range(len(text) - n + 1))


def brute_vectors(rows, cosine):
    def usable(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [usable(r) for r in rows]
    near = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    near.append((i, j))
    of, links = groups(len(rows), near), collections.Counter(k for pair in near for k in pair)
    names = collections.defaultdict(list)
    for i, r in enumerate(rows):
        names[of[i]] += [r[0]] if r[0] is not None else []
    return [(r[0], links[i], min(names[of[i]], default=None), r[0] is not None and r[0] == min(names[of[i]], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("cell, pivots", [(2000, 256), (10, 256), (4, 3)])
def test_near_vectors(spark, cell, pivots, monkeypatch):
    import gridtide.llm.embedding_dedup as vectors
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "MAX_PIVOTS", pivots)  # with 3, cells within cells
    monkeypatch.setattr(vectors, "BLOCK", 16 if cell < 2000 else 4000)
    levels, cells = [], vectors._cells
    monkeypatch.setattr(vectors, "_cells", lambda points, cosine, level: levels.append(level) or cells(points, cosine, level))
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        base = rng.normal(size=8) if i % 4 == 0 else np.array(rows[-1][1]) + rng.normal(0, 0.08, 8)
        rows.append((i, [float(x) for x in np.float32(base)], i // 80))
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 8, 0), (304, [float("nan")] * 8, 0),
             (305, [None] + [1.0] * 7, 0), (306, [], 0), (307, [float("inf")] + [0.0] * 7, 0), (None, rows[0][1], 0), (308, rows[0][1][:4], 0),
             (309, [x * 3 for x in rows[0][1]], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as links", "'x' as vector", "2 as part")
    got = [tuple(r) for r in near_vectors(frame).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert ordered(got) == ordered(brute_vectors(rows, 0.98))
    assert levels == [0] if pivots == 256 else len(levels) > 1


def test_near_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
