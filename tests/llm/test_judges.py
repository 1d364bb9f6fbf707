"""Learned judges by held-out accuracy, rules by SQL and by hand."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from brute import ordered, words
from pyspark.sql import functions as F

from gridtide.llm import language_id, license_scan, queries, quality_ranking, quality_rules, url_filter
from gridtide.llm.license_scan import scan_licences


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_language_held_out(spark, larger, plain, corpus):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    network = language_id.learn_languages(docs.where(~held))
    judged = language_id.predict_language(docs.where(held), network).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in judged]) > 0.97
    edge = language_id.predict_language(corpus, network)
    assert edge.schema["score"].dataType.simpleString() == "double"
    for row in edge.collect():
        blank = not any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == blank and 0 <= row["score"] <= 1
    assert edge.count() == len(plain)
    assert language_id.predict_language(corpus.limit(0), network).count() == 0


def test_every_label_and_very_long_texts_are_learned(spark, monkeypatch):
    long = "slovo dlouhe " * 20_000
    rows = [(i, f"plain words number {i} of a text", "en") for i in range(50)] + [(99, long, "cs")]
    rows += [(1000 + i, f"{chr(0x4e00 + i)}" * 30, f"x{i:03}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    network = language_id.learn_languages(docs)
    assert network.labels == sorted({r[2] for r in rows})
    few = language_id.learn_languages(docs.where("doc_id < 1000"))
    assert {r["lang_pred"] for r in language_id.predict_language(docs.where("doc_id = 99"), few).collect()} == {"cs"}
    monkeypatch.setattr(language_id, "MOST_LABELS", 200)
    with pytest.raises(ValueError, match="more than 200 labels"):
        language_id.learn_languages(docs)


def test_pooled_probabilities_match_a_loop_over_bytes():
    """Each byte on its own, by plain arithmetic, in windows of the same length."""
    rng = np.random.default_rng(5)
    h, names = 2, ["a", "b", "c"]
    net = language_id.ByteNetwork(names, [rng.normal(size=(256, 3 * h)).astype(np.float32) for _ in range(2)],
                                  [rng.normal(size=(h, 3 * h)).astype(np.float32) for _ in range(2)], rng.normal(size=(2 * h, 3)), rng.normal(size=3))
    texts = [b"", b"12", b"Hello, w\xc3\xb6rld", bytes(rng.integers(32, 127, 250).astype(np.uint8))]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(table, matrix, data):
        state, out = np.zeros(h), []
        for byte in data:
            gates = sigmoid(table[byte, :2 * h] + state @ matrix[:, :2 * h])
            candidate = np.tanh(table[byte, 2 * h:] + (gates[h:] * state) @ matrix[:, 2 * h:])
            state = (1 - gates[:h]) * state + gates[:h] * candidate
            out.append(state)
        return out
    want = []
    for text in texts:
        total, places = np.zeros(3), 0
        for lo in range(0, len(text), language_id.WINDOW):
            part = text[lo:lo + language_id.WINDOW]
            padded = part + bytes(language_id.WINDOW - len(part))
            forth, back = states(net.tables[0], net.recurrent[0], padded), states(net.tables[1], net.recurrent[1], padded[::-1])[::-1]
            for i, byte in enumerate(part):
                if byte >= 128 or chr(byte).isalpha():
                    e = np.exp(np.concatenate([forth[i], back[i]]) @ net.out + net.bias)
                    total, places = total + e / e.sum(), places + 1
        want.append(total / max(places, 1))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(language_id.document_probabilities(net, data, offsets), want, atol=1e-4)


def test_language_without_labels(corpus):
    network = language_id.learn_languages(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in language_id.predict_language(corpus, network).select("lang_pred").collect()} == {"und"}


def test_gradients_through_time_match_differences():
    rng = np.random.default_rng(0)
    table, matrix = rng.normal(0, 0.5, (256, 9)), rng.normal(0, 0.5, (3, 9))
    steps, aim = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.normal(size=(6, 4, 3))

    def loss(t, m):
        return float((language_id._run(t, m, steps)[0].astype(float) * aim).sum())
    _, cache = language_id._run(table, matrix, steps, keep=True)
    d_table, d_matrix = language_id._back(table, matrix, steps, cache, aim)
    for grad, weights, place in ((d_matrix, matrix, (1, 7)), (d_matrix, matrix, (2, 1)), (d_table, table, (steps[2, 1], 4))):
        up, down = weights.copy(), weights.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        numeric = (loss(up, matrix) - loss(down, matrix) if weights is table else loss(table, up) - loss(table, down)) / 2e-2
        assert grad[place] == pytest.approx(numeric, abs=2e-3)


def test_quality_held_out(spark, larger, corpus, plain):
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    ranking = quality_ranking.learn_quality(docs, labels.where(queries.id_checksum() % 5 != 0))
    judged = quality_ranking.score_quality(docs, ranking).join(labels, "doc_id").where(queries.id_checksum() % 5 == 0).collect()
    good = [r["score"] for r in judged if r["quality"] == 1]
    bad = [r["score"] for r in judged if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in judged]) > 0.95
    edge = quality_ranking.score_quality(corpus, ranking).collect()
    assert len(edge) == len(plain) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in edge)
    assert quality_ranking.score_quality(corpus.limit(0), ranking).count() == 0


def test_quality_without_pairs_rejects_nothing(corpus, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = quality_ranking.score_quality(corpus, quality_ranking.learn_quality(corpus, labels)).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.3, 1)}


def labelled_features(n_good, n_bad, seed):
    """Overlapping features of two labels, one of them constant, one with far values, some rows twice."""
    rng = np.random.default_rng(seed)
    good = np.arange(n_good + n_bad) < n_good
    features = rng.normal(size=(len(good), len(quality_ranking.FEATURES))) + good[:, None] * np.linspace(-0.7, 0.7, len(quality_ranking.FEATURES))
    features[:, 3] = 2.0
    features[:, 5] = rng.standard_cauchy(len(good)) + good
    features[1::10] = features[::10][:len(features[1::10])]
    return features, good


def slope_over_all_pairs(ranking, features, good, ridge=1e-3):
    x = ranking.scaled(features)
    score = x @ ranking.weights
    chance = 1 / (1 + np.exp(score[good][:, None] - score[~good]))  # that the bad one wins
    return (chance.sum(axis=0) @ x[~good] - chance.sum(axis=1) @ x[good]) / chance.size + ridge * ranking.weights


def test_quality_ranking_is_the_optimum_over_all_pairs(spark):
    features, good = labelled_features(700, 400, 5)
    rows = spark.createDataFrame([(bool(g), x.tolist()) for g, x in zip(good, features)], "good boolean, features array<double>")
    ranking = quality_ranking.fit_ranking(rows.repartition(3))
    assert ranking.mean == pytest.approx(features.mean(axis=0), rel=1e-7)
    assert ranking.spread == pytest.approx(np.where(features.std(axis=0) > 1e-9, features.std(axis=0), 1.0), rel=1e-7)
    assert np.abs(slope_over_all_pairs(ranking, features, good)).max() < 1e-8
    scores = ranking.raw(features)
    parted = {v: np.mean(scores[good] > v) + np.mean(scores[~good] <= v) for v in scores}
    low = min(v for v in parted if parted[v] >= max(parted.values()) - 1e-12)
    assert low < ranking.cut <= min(v for v in parted if v > low)
    again = quality_ranking.fit_ranking(rows.repartition(7).sortWithinPartitions("features"))
    assert (again.weights == ranking.weights).all() and (again.mean == ranking.mean).all() and again.cut == ranking.cut


@pytest.mark.parametrize("few", [quality_ranking.FEW_LABELS, 10])
def test_quality_is_learned_from_every_labelled_document(spark, monkeypatch, few):
    monkeypatch.setattr(quality_ranking, "FEW_LABELS", few)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Word", "other", "x|y", "12", "a!", "end."], rng.integers(3, 12))) for _ in range(10_000)]
    label = [int(t.count("|") + rng.integers(0, 3) < 2) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (90_000, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(label)) + [(None, 1), (90_001, 0), (90_000, None)], "doc_id long, quality int")
    ranking = quality_ranking.learn_quality(docs.repartition(4), labels)
    features, good = quality_ranking.text_features(pa.array(texts)), np.array(label) == 1
    assert min(good.sum(), (~good).sum()) > 3_000
    assert ranking.mean == pytest.approx(features.mean(axis=0), rel=1e-7, abs=1e-12)
    assert np.abs(slope_over_all_pairs(ranking, features, good)).max() < 1e-8


def test_quality_with_labels_that_nothing_or_everything_parts(spark):
    rows = [(bool(i % 2), [float(i // 2)] * len(quality_ranking.FEATURES)) for i in range(40)]
    level = quality_ranking.fit_ranking(spark.createDataFrame(rows, "good boolean, features array<double>"))
    assert np.abs(level.weights).max() < 1e-7 and (level.raw(np.array([r[1] for r in rows])) >= level.cut).all()
    rows = [(i >= 30, [float(i)] + [0.0] * (len(quality_ranking.FEATURES) - 1)) for i in range(40)]
    parted = quality_ranking.fit_ranking(spark.createDataFrame(rows, "good boolean, features array<double>"))
    assert (parted.raw(np.array([r[1] for r in rows])) >= parted.cut).tolist() == [r[0] for r in rows]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, larger, name):
    assert difference(queries.QUERIES[name](spark, larger), connect(larger), queries.SQL[name]) is None


def test_line_rules_on_edge_rows(corpus, plain):
    got = quality_rules.line_frequency_rules(corpus).collect()
    want = []
    for doc_id, text, *_ in plain:
        text = text or ""
        w = words(text)
        runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        from collections import Counter
        times = Counter(runs)
        covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
                     len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered(tuple(r[k] for k in keys) for r in got) == ordered(want)
    assert quality_rules.line_frequency_rules(corpus.limit(0)).count() == 0


def test_lines_above_the_limit_deplete(spark):
    own = " ".join(f"own{i}" for i in range(60))
    menu = " ".join(f"menu{i}" for i in range(80))
    rows = [(i, f"{own} {i}\n{menu.upper() if i % 2 else menu}  \n", "h") for i in range(30)] + [(99, f"{menu}\n{own}", "other"), (100, f"{own} z\n{own.replace('own', 'more')}\n{menu}", "h")]
    got = {r["doc_id"]: r for r in quality_rules.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["removed_lines"] == [1] and got[0]["n_words_left"] == 61 and not got[0]["kept"]
    assert got[99]["removed_lines"] == [] and got[99]["kept"]
    assert got[100]["removed_lines"] == [2] and got[100]["kept"]


def test_the_line_limit_holds_in_hosts_of_every_size(spark):
    own = " ".join(f"own{i}" for i in range(60))
    menu = " ".join(f"menu{i}" for i in range(80))
    rows = [(i, f"{own} {i}\n{menu if i < 11 else menu.upper() + ' ten' if i < 21 else i}", host)
            for host, n in (("small", 100), ("hot", 5000), (None, 3000)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.line_frequency_rules(docs).where("not kept or size(removed_lines) > 0").collect()
    assert ordered((r["doc_id"], r["removed_lines"], r["kept"]) for r in got) == ordered((i, [1], False) for i in range(11) for _ in range(3))
    assert {r["host"]: r["n_docs"] for r in quality_rules.frequent_lines(docs).collect()} == {"small": 11, "hot": 11, None: 11}
    assert {r["host"] for r in quality_rules.frequent_lines(docs, min_share=0.01).collect()} == {"small"}


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.net/en/x?q=1", "https://example.net/de/", "http://net", "http://net/", "http://www.example.com/de/1#a", "http://b.org/fr/", "http://border.org/fr",
            "http://example.com/en/", None, "", "no scheme", "http://", "ftp://x.example.NET:80/en/#://", "http://myexample.net/en/", "a?://b.org/fr/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").selectExpr("*", "'x' as host", "0 as verdict")
    labelled = queries.labelled_urls(pages)
    rows = url_filter.judge_urls(pages, url_filter.learn_urls(labelled), queries.URL_RULES).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows}
    assert len(rows) == len(urls) + 1
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/") and by[1][2] == "net/" and by[2] == ("net", "", None) and by[3][2] == "net/"
    assert by[4] == ("www.example.com", "/de/1", "example.com/de/") and by[5][2] == "org/fr/" and by[6][2] is None and by[7][2] is None
    assert by[8] == by[9] == by[10] == by[11] == ("", "", None) and by[12] == ("x.example.net:80", "/en/", None) and by[13][2] == "net/" and by[14][0] == "b.org"
    verdicts = {"example.net/en/": "allow", "net/": "block", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r["verdict"] == verdicts.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block") for r in rows)
    none = pages.limit(0)
    assert url_filter.judge_urls(none, url_filter.learn_urls(queries.labelled_urls(none)), queries.URL_RULES).count() == 0


def test_trees_learn_what_a_split_can_tell():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.1)).astype(float)
    model = url_filter.boost(x[:3000], y[:3000])
    assert np.mean((model.chance(x[3000:]) >= 0.5) == y[3000:]) > 0.95


def test_unruled_urls_of_held_out_hosts(spark, larger):
    pages = spark.read.parquet(f"{larger}/pages.parquet").select("page_id", "url")
    labelled = queries.labelled_urls(pages)
    held = F.crc32(F.col("host").cast("binary")) % 3 == 0
    model = url_filter.learn_urls(labelled.where(~held))
    rows = url_filter.judge_urls(labelled.where(held).select("page_id", "url", "blocked"), model, queries.URL_RULES).where("rule is null").collect()
    assert len(rows) > 20 and np.mean([(r["verdict"] == "block") == r["blocked"] for r in rows]) > 0.85


def test_suffixes_count_all_rows_without_the_own_label(spark):
    rows = [(f"http://a{i}.shop{i % 7}.tld/{i}", i % 3 == 0) for i in range(2000)] + [("http://lone.one/x", True), ("http://bare/", False), (None, True), ("http://x.y/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    host, path = url_filter.host_and_path(F.col("url"))
    labelled = labelled.withColumns({"host": host, "path": path})
    model = url_filter.learn_urls(labelled, sample=50)
    want = {}
    for url, bad in rows[:-2]:
        name = url.split("/")[2]
        for suffix in {name.split(".")[-1], ".".join(name.split(".")[-2:])}:
            was = want.get(suffix, (0, 0))
            want[suffix] = (was[0] + bad, was[1] + 1)
    assert {r["suffix"]: (r["bad"], r["n"]) for r in model.suffixes.collect()} == want
    prior = sum(r[1] for r in rows[:-2]) / 2002
    assert model.prior == pytest.approx(prior)
    own, names = url_filter._with_shares(labelled.where("host = 'lone.one'"), model.suffixes, prior, F.col("blocked"))
    assert [tuple(r) for r in own.select(*names).collect()] == [pytest.approx((prior, prior))]
    other, names = url_filter._with_shares(labelled.where("host = 'a0.shop0.tld'").withColumn("_bad", F.lit("mine")), model.suffixes, prior)
    bad, n = want["shop0.tld"]
    assert other.select(names[1]).first()[0] == pytest.approx((bad + 10 * prior) / (n + 10)) and other.first()["_bad"] == "mine"


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 300_000 + "net/" + "x/" * 300_000), (2, "http://b.net/?" + "q=1&" * 200_000)], "page_id long, url string")
    rows = url_filter.judge_urls(pages, url_filter.learn_urls(queries.labelled_urls(pages)), queries.URL_RULES).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in rows) == [(1, "net/", "block"), (2, "net/", "block")]


def test_first_split_is_the_best_of_all():
    """The root of a single tree against every split of every feature, tried one by one."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 300) > 5).astype(float)
    p = y.mean()
    best = (-1.0, 0, 0.0)
    for j in range(3):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < url_filter.LEAST:
                continue
            score = [(y[side] - p).sum() ** 2 / (p * (1 - p) * side.sum() + 1) for side in (left, ~left)]
            best = max(best, (sum(score), j, cut))
    split, threshold, value = url_filter.boost(x, y, trees=1).trees[0]
    assert (split[0], threshold[0]) == best[1:]
    assert value[0] == pytest.approx(0, abs=1e-9)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software!\nThe software is provided \"as is\", without warranty of any kind."
    rows = [(1, mit), (2, "Text. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
            (3, None), (4, ""), (5, "Nothing here."), (6, "Released under the MIT License.\nmore\nLICENSED UNDER CC BY-NC 4.0."), (6, "Released under the MIT License."),
            (None, "All rights  reserved")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as licences", "1 as n_sentences")
    got = ordered((r["doc_id"], r["licences"], r["licence_group"]) for r in scan_licences(frame).collect())
    assert got == ordered([(1, "MIT", "permissive"), (2, "Apache-2.0", "permissive"), (3, "", None), (4, "", None), (5, "", None),
                           (6, "MIT,CC-BY-NC-4.0", "restricted"), (6, "MIT", "permissive"), (None, "all-rights-reserved", "restricted")])
    assert scan_licences(frame.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Copyright (c) 2009, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = GPL.replace(":", ";").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("General", "Lesser General").replace("version 2", "version 2.1")
AGPL = GPL.replace("General", "Affero General")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
GPL2_TITLE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n"
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.
The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License.
"""
LONG_HOLDER = BSD3.replace("the copyright holder", "the " + "very " * 200 + "long holder")
CC = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."


def licence_rows(rows):
    keys = ("doc_id", "n_sentences", "sentence_ids", "standard_ids", "licences", "licence_group")
    return ordered(tuple(r[k] for k in keys) for r in rows)


def sql_rows(rows):
    """The checking SQL over (doc_id, text) rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    found = con.execute(license_scan.licence_sql("t", "doc_id"))
    names = [c[0] for c in found.description]
    return licence_rows(dict(zip(names, row)) for row in found.fetchall())


def test_licence_sql_and_operator_agree_on_edge_rows(corpus, plain):
    rows = [(r[0], None if r[1] is None else r[1].replace("\0", "")) for r in plain]
    got = scan_licences(corpus.withColumn("text", F.replace("text", F.lit("\0"), F.lit("")))).collect()
    assert licence_rows(got) == sql_rows(rows)


def test_licences_of_a_very_long_text(spark):
    text = "\n" * 200_000 + "plain words of a line. " * 100_000 + "\n \n" + MIT + "x" * 500_000 + " \t" * 200_000
    got = scan_licences(spark.createDataFrame([(1, text), (2, "licens" + "\n-" * 300_000)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["licences"]) for r in got] == [(1, "MIT"), (2, "")]


def test_standard_licence_texts_wrapped_and_not(spark):
    """Each text as it stands, on one line, as a comment, with Windows line ends and inside other text."""
    want = {MIT: ("MIT", "permissive"), BSD2: ("BSD-2-Clause", "permissive"), BSD3: ("BSD-3-Clause", "permissive"), GPL: ("GPL-3.0", "copyleft"),
            GPL2: ("GPL-2.0", "copyleft"), LGPL: ("LGPL-2.1", "copyleft"), AGPL: ("AGPL-3.0", "copyleft"), APACHE: ("Apache-2.0", "permissive"),
            ISC: ("ISC", "permissive"), MPL: ("MPL-2.0", "copyleft"), CC: ("CC-BY-NC-4.0", "restricted"),
            "Foo is released\nunder the MIT License, see the file.": ("MIT", "permissive"), "It is not licensed under the MIT license, sorry.": ("", None),
            "The software comes with permission, no licence.": ("", None), "The code is no longer licensed under the MIT License.": ("", None),
            "Nothing here is licensed under CC BY 4.0, ask first.": ("", None), "No part of it is licensed under CC BY 4.0, ask first.": ("", None),
            "We compared the GNU General Public License, version 2, June 1991 with others.": ("", None),
            "The contents, which need permission, are like the MIT text that says permission is hereby granted, free of charge.": ("", None),
            "SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause)": ("BSD-3-Clause,GPL-2.0", "copyleft"), "spdx-license-identifier: MITX": ("", None),
            GPL2_TITLE: ("GPL-2.0", "copyleft"), ASF: ("Apache-2.0", "permissive"),
            LONG_HOLDER: ("BSD-3-Clause", "permissive")}
    shapes = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "".join(f" * {x}\n" for x in t.splitlines()), lambda t: t.replace("\n", "\r\n"),
              lambda t: f"int main() {{}}\n// see below\n{t}\nand more text"]
    rows = [(i, shape(text)) for i, text in enumerate(want) for shape in shapes]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_licences(frame).collect()
    assert len(got) == len(rows)
    assert licence_rows(got) == sql_rows(rows)
    assert [(r["doc_id"], r["licences"], r["licence_group"]) for r in got] == [(i, *found) for i, found in enumerate(want.values()) for _ in shapes]


def test_several_licences_in_one_text(spark):
    rows = [(1, BSD3 + MIT + GPL), (2, BSD2 + BSD3), (3, MIT + "\nLicensed under CC BY-NC 4.0.\n"), (4, "All rights reserved.\nReleased under the MIT License."),
            (5, f"All rights reserved.\n{APACHE}")]
    got = {r["doc_id"]: (r["licences"], r["licence_group"]) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT,BSD-3-Clause,GPL-3.0", "copyleft"), 2: ("BSD-3-Clause,BSD-2-Clause", "permissive"), 3: ("MIT,CC-BY-NC-4.0", "restricted"),
                   4: ("MIT,all-rights-reserved", "restricted"), 5: ("Apache-2.0", "permissive")}


def test_standard_sentences_have_a_hint():
    known = license_scan.STANDARD | license_scan.TITLES | license_scan.GRANTS
    assert all(any(hint in sentence for hint in license_scan.HINTS) for sentence in known)
    assert {x for _, _, wanted in license_scan.STANDARD_RULES for x in wanted} <= {*known.values(), *license_scan.SPDX.values()}


def test_id_checksum(spark):
    rows = spark.createDataFrame([(7,), (None,)], "doc_id long").select(queries.id_checksum()).collect()
    assert [r[0] for r in rows] == [zlib.crc32(b"7"), 0]
