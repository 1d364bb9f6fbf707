"""URL verdicts: ordered host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees read the URL alone: lengths, depth, digit share, entropy, parameters, marks, and how often URLs
with the same host suffix were blocked among all labelled ones, a URL's own label apart. The trees learn from a
bounded sample, the suffix table counts every labelled row and is joined to the pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import with_columns
from gridtide.session import materialise

SAMPLE_ROWS = 20_000   # labelled URLs to learn from, at most
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.2, 32, 20
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digits", "host_digits", "entropy", "host_entropy",
            "parameters", "query_length", "fragment", "secure", "hyphens", "host_hyphens", "longest_label", "last_suffix", "two_suffix")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z in lower case) and path; both empty for a null URL and one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWERED), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest ``(verdict, host/path)`` rule whose host is the host or a parent of it and whose path begins the path."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(data: bytes) -> float:
    if not data:
        return 0.0
    share = np.unique(np.frombuffer(data, np.uint8), return_counts=True)[1] / len(data)
    return float(-(share * np.log2(share)).sum())


def url_features(url: str | None, host: str, path: str, last_share: float, two_share: float) -> list[float]:
    url = url or ""
    _, _, tail = url.partition("?")
    query, mark, _ = tail.partition("#")
    labels = host.split(".")
    digits, host_digits = sum(c.isdigit() for c in url), sum(c.isdigit() for c in host)
    return [len(url), len(host), len(path), path.count("/"), len(labels), digits / max(len(url), 1), host_digits / max(len(host), 1),
            _entropy(url.encode("utf-8")), _entropy(host.encode("utf-8")), query.count("=") + query.count("&"), len(query),
            float("#" in url), float(url[:6].lower() == "https:"), url.count("-"), host.count("-"), max(map(len, labels)),
            last_share, two_share]


@dataclass
class BoostedTrees:
    """Per tree: split feature (-1 for a leaf), threshold, and value, in heap order."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for split, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                feature = split[node]
                right = x[np.arange(len(x)), np.maximum(feature, 0)] > threshold[node]
                node = np.where(feature < 0, node, 2 * node + 1 + right)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> BoostedTrees:
    """Logistic loss, second-order leaf values, splits at quantiles of each feature."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    model = BoostedTrees(float(np.log(share / (1 - share))))
    if not len(y):
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # code <= i means value <= edges[i]
    total, size = np.full(len(y), model.start), 2 ** (DEPTH + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, bend = y - p, p * (1 - p)
        split, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            g, h = gradient[rows], bend[rows]
            value[at] = rate * g.sum() / (h.sum() + 1.0)
            if 2 * at + 2 >= size or len(rows) < 2 * LEAST:
                continue
            best = (1e-6, -1, 0)
            for j in range(x.shape[1]):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(codes[rows, j], w, k))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
                top = int(gain.argmax())
                best = max(best, (float(gain[top]), j, top), key=lambda b: b[0])
            if best[1] >= 0:
                split[at], threshold[at] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (codes[rows, best[1]] > best[2])
        model.trees.append((split, threshold, value))
        total += value[node]
    return model


SMOOTHING = 10  # URLs of the overall share that each suffix gets
LAST, TWO = "last_suffix", "two_suffix"


@dataclass
class UrlModel:
    """Table ``suffix, bad, n`` of the labelled URLs per suffix, their overall share of blocked ones, and the trees."""

    suffixes: DataFrame
    prior: float
    trees: BoostedTrees


def _features(urls, hosts, paths, last, two) -> np.ndarray:
    rows = [url_features(*row) for row in zip(urls, hosts, paths, last, two)]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Blocked and all labelled URLs (``bad``, ``n``) per last label and per last two labels of the host."""
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in (1, 2)]))
    return labelled.select(F.explode(ends).alias("suffix"), F.col("blocked").cast("long").alias("bad")).groupBy("suffix").agg(
        F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))


def _spare(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _with_shares(rows: DataFrame, suffixes: DataFrame, prior: float, own: Column | None = None) -> tuple[DataFrame, list[str]]:
    """``rows`` with the smoothed shares of both suffixes of ``host``, and the new names; ``own`` is a label to take out.

    A plain join: broadcast if the table is measured as small, else hot suffixes are split by the adaptive planner.
    """
    names = []
    for k, name in ((1, LAST), (2, TWO)):
        names.append(_spare(rows.columns, f"_{name}"))
        key, bad, n = (_spare(rows.columns, f"_{x}") for x in ("suffix", "bad", "n"))
        right = suffixes.toDF(key, bad, n)
        rows = rows.join(right, F.substring_index("host", ".", -k) == F.col(key), "left")
        less = (own.cast("long"), F.lit(1)) if own is not None else (F.lit(0), F.lit(0))
        share = (F.coalesce(F.col(bad) - less[0], F.lit(0)) + SMOOTHING * F.lit(prior)) / (F.coalesce(F.col(n) - less[1], F.lit(0)) + SMOOTHING)
        rows = rows.withColumn(names[-1], share).drop(key, bad, n)
    return rows, names


def learn_urls(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> UrlModel:
    """A model from ``url, host, path, blocked``: suffixes counted over all labelled rows, trees from at most ``sample``.

    The sample is spread by a hash of the URL; each of its rows sees its suffixes without its own label. Repeated rows count
    each time. Without labelled rows every URL gets the score 0.001. Runs jobs when called.
    """
    known = labelled.where("url is not null and blocked is not null").select("url", "host", "path", "blocked")
    n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    prior, order = bad / n if n else 0.0, F.xxhash64("url")
    suffixes = materialise(suffix_counts(known), "suffixes")
    if n > 2 * sample:
        known = known.where(F.pmod(order, F.lit(1_000_000)) < int(2_000_000 * sample / n))
    drawn, names = _with_shares(known.orderBy(order, "url", "blocked").limit(sample), suffixes, prior, F.col("blocked"))
    rows = sorted(drawn.select("url", "host", "path", *names, "blocked").collect())
    x = _features(*([r[i] for r in rows] for i in range(5)))
    return UrlModel(suffixes, prior, boost(x, np.array([r[5] for r in rows], float)))


def _judge(trees: BoostedTrees, at: tuple[int, ...], keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(*(batch.column(i).to_pylist() for i in at))
            yield with_columns(batch.select(range(keep)), {"block_score": pa.array(trees.chance(x), pa.float64())})
    return run


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and ``rule`` (null if none fits)."""
    host, path = host_and_path(F.col(url_col))
    step = pages.drop("host", "path", "rule").withColumns({"host": host, "path": path})
    return step.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``: the rule's, else block from ``cut`` on.

    Null URLs and those without ``://`` have empty host and path and no rule; the trees judge them too.
    One row per row; an empty table gives no rows; columns with the new names are replaced.
    """
    shipped(pages.sparkSession)
    ruled = with_rules(pages.drop("block_score", "verdict"), rules, url_col)
    wide, names = _with_shares(ruled, model.suffixes, model.prior)
    schema = StructType([*ruled.schema.fields, StructField("block_score", DoubleType())])
    at = tuple(wide.columns.index(c) for c in (url_col, "host", "path", *names))
    scored = wide.mapInArrow(_judge(model.trees, at, len(ruled.columns)), schema)
    verdict = F.when(F.col("block_score") >= cut, "block").otherwise("allow")
    for name, rule in rules:
        verdict = F.when(F.col("rule") == rule, name).otherwise(verdict)
    return scored.withColumn("verdict", verdict.cast(StringType()))
