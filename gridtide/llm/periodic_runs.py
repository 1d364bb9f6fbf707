"""Periodic runs of words: recompression grammars answer how far two places of a text agree.

The word numbers of some texts, each text between marks of its own, become a run-length grammar: levels that
alternately turn a block of one repeated symbol and a pair (left symbol, right symbol) into one new symbol. Equal
words read equally at every level but for their borders, so two places are compared by climbing the levels while
they agree and coming down where they part: a few array steps per level for all questions at once. A run of period
q agrees with itself q words further on for at least ``max(least - q, (times - 1) * q)`` words, so for every q the
multiples of that number are the only places to ask: a harmonic grid of about n log n places. All names are exact,
no hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtide.llm.shipping import shipped
from gridtide.llm.textkit import mix, raw_bytes, slices, with_columns

PIECE_BYTES = 1 << 20   # of a text whose words are held as objects at once
ASKED = 1 << 20         # places of the grid that are looked at in one go
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Level:
    """Symbols of a level and how they are grouped into those of the next."""

    blocks: bool          # groups are blocks of one symbol, else pairs and single symbols
    symbols: np.ndarray
    first: np.ndarray     # first symbol of each group; one more at the end
    group: np.ndarray     # group of each symbol
    names: np.ndarray     # symbol of each group


def _grouped(symbols: np.ndarray, head: np.ndarray, names: np.ndarray, blocks: bool) -> Level:
    first = np.flatnonzero(head).astype(np.int32)
    group = (np.cumsum(head, dtype=np.int32) - 1).astype(np.int32)
    return Level(blocks, symbols, np.append(first, np.int32(len(symbols))), group, names)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar, down to one symbol."""
    levels, symbols = [], symbols.astype(np.int64)
    fresh, turn = int(symbols.max()) + 1 if len(symbols) else 0, 0
    while len(symbols) > 1:
        head = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=head[1:])
        if not head.all():
            first = np.flatnonzero(head)
            length = np.diff(np.append(first, len(symbols)))
            names = symbols[first]
            long = np.flatnonzero(length > 1)
            _, at = np.unique(names[long] * (int(length.max()) + 1) + length[long], return_inverse=True)
            names[long] = fresh + at
            fresh += int(at.max()) + 1
            levels.append(_grouped(symbols, head, names, True))
            symbols = names
            if len(symbols) == 1:
                break
        pairs = np.zeros(0, np.int64)
        while not len(pairs):  # neighbours differ, so some turn parts two of them
            turn += 1
            left = (mix(symbols.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
            ahead = left[:-1] & ~left[1:]
            behind = ~left[:-1] & left[1:]
            pairs = np.flatnonzero(ahead if ahead.sum() >= behind.sum() else behind)
        head = np.ones(len(symbols), bool)
        head[pairs + 1] = False
        _, at = np.unique(symbols[pairs] * fresh + symbols[pairs + 1], return_inverse=True)
        names = symbols[head]
        names[pairs - np.arange(len(pairs))] = fresh + at
        fresh += int(at.max()) + 1
        levels.append(_grouped(symbols, head, names, False))
        symbols = names
    return levels


def _edge(level: Level, at: np.ndarray, onward: bool) -> np.ndarray:
    """Whether a symbol is the first of its group; the last, looking back."""
    return level.first[level.group[at]] == at if onward else level.first[level.group[at] + 1] - 1 == at


def _same(level: Level, a: np.ndarray, b: np.ndarray, onward: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many equal symbols of a level to pass from places that may differ above, and whether both then stand at an edge."""
    equal = level.symbols[a] == level.symbols[b]
    if not level.blocks:
        return equal.astype(np.int64), equal
    ga, gb = level.group[a], level.group[b]
    left_a = level.first[ga + 1] - a if onward else a - level.first[ga] + 1
    left_b = level.first[gb + 1] - b if onward else b - level.first[gb] + 1
    return np.where(equal, np.minimum(left_a, left_b), 0), equal & (left_a == left_b)


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray, onward: bool = True) -> np.ndarray:
    """Number of equal symbols from places ``a`` and ``b`` (different, and followed by something different) onward or back."""
    step = 1 if onward else -1
    places = np.stack([a, b]).astype(np.int64)
    begun = places[0].copy()
    live = np.arange(len(a))
    parted: list[np.ndarray] = []
    for level in levels:
        x, y = places[:, live]
        whole = _edge(level, x, onward) & _edge(level, y, onward) & (level.names[level.group[x]] == level.names[level.group[y]])
        run, even = _same(level, x, y, onward)
        run = np.where(whole, 0, run)
        x, y = x + step * run, y + step * run
        up = whole | even
        if not level.blocks:  # one passed, and yet inside a pair: the next ones differ
            up &= whole | (_edge(level, x, onward) & _edge(level, y, onward))
        places[0, live], places[1, live] = np.where(up, level.group[x], x), np.where(up, level.group[y], y)
        parted.append(live[~up])
        live = live[up]
        if not len(live):
            break
    below = np.zeros(0, np.int64)
    for at in range(len(parted) - 1, -1, -1):
        level = levels[at]
        if len(below):  # different groups that may begin alike
            x, y = places[:, below]
            x, y = (level.first[x], level.first[y]) if onward else (level.first[x + 1] - 1, level.first[y + 1] - 1)
            run, _ = _same(level, x, y, onward)
            places[0, below], places[1, below] = x + step * run, y + step * run
        below = np.concatenate([below, parted[at]])
    return step * (places[0] - begun)


def _grid(base: np.ndarray, n: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the questions to ask about texts of ``n`` words from ``base``."""
    longest = np.where(n >= least, n // times, 0)
    ends = np.cumsum(longest)
    lo, total = 0, int(ends[-1]) if len(ends) else 0
    while lo < total:
        hi = min(lo + ASKED // 4, total)
        number = np.arange(lo, hi)
        text = np.searchsorted(ends, number, side="right")
        period = number - (ends[text] - longest[text]) + 1
        stride = np.maximum(least - period, (times - 1) * period)
        asked = -(-(n[text] - period) // stride)
        upto = np.cumsum(asked)
        take = max(1, int(np.searchsorted(upto, ASKED, side="right")))  # at least one period, the rest next time
        period, stride, asked, upto, text = period[:take], stride[:take], asked[:take], upto[:take], text[:take]
        of = np.repeat(np.arange(take), asked)
        place = (np.arange(int(upto[-1])) - (upto - asked)[of]) * stride[of] + base[text][of]
        yield place, period[of]
        lo += take


def runs_of(words: list[np.ndarray], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """For each array of word numbers its runs as rows (start, length, period), by start, then period."""
    n = np.array([len(w) for w in words], np.int64)
    marks = int(max((w.max() for w in words if len(w)), default=-1)) + 1
    parts = [np.array([marks], np.int64)]
    for k, w in enumerate(words):
        parts += [w, np.array([marks + 1 + k], np.int64)]
    symbols = np.concatenate(parts)
    base = 1 + np.cumsum(n + 1) - (n + 1)
    found = []
    levels: list[Level] = []
    for place, period in _grid(base, n, least, times):
        hit = np.flatnonzero(symbols[place] == symbols[place + period])
        if not len(hit):
            continue
        levels = levels or recompress(symbols)
        place, period = place[hit], period[hit]
        after = agreement(levels, place, place + period)
        back = agreement(levels, place - 1, place + period - 1, onward=False)
        length = back + after + period
        long = length >= np.maximum(least, times * period)
        rows = np.stack([(place - back)[long], length[long], period[long]])
        found.append(np.unique(rows, axis=1))
    if not found:
        return [np.zeros((0, 3), np.int64) for _ in words]
    rows = np.unique(np.concatenate(found, axis=1), axis=1)  # by start, length, period
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)  # the same stretch with a multiple of its period
    rows = rows[:, new]
    rows = rows[:, np.lexsort((rows[2], rows[0]))]
    text = np.searchsorted(base, rows[0], side="right") - 1
    rows[0] -= base[text]
    cuts = np.searchsorted(text, np.arange(len(words) + 1))
    return [rows[:, cuts[k]:cuts[k + 1]].T for k in range(len(words))]


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    lo = 0
    while lo < len(raw):
        blank = _BLANK.search(raw, lo + PIECE_BYTES) if lo + PIECE_BYTES < len(raw) else None
        hi = blank.start() if blank else len(raw)
        yield raw[lo:hi].split()  # bytes split at exactly these blanks
        lo = hi


def _kept(raw: bytes, rows: np.ndarray, n: int) -> str:
    if not len(rows):
        return b" ".join(b" ".join(p) for p in _pieces(raw) if p).decode("utf-8")
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    keep, out, lo = np.cumsum(change)[:n] == 0, [], 0
    for words in _pieces(raw):
        out += [b" ".join([words[i] for i in np.flatnonzero(keep[lo:lo + len(words)])])]
        lo += len(words)
    return b" ".join(x for x in out if x).decode("utf-8")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(at: int, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at)):
                number = defaultdict(count().__next__)
                texts = [data[offsets[i]:offsets[i + 1]].tobytes() for i in range(hi - lo)]
                words = [np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(number.__getitem__, p), np.int64, len(p)) for p in _pieces(t)]])
                         for t in texts]
                del number
                runs = runs_of(words, least, times)
                sizes = [len(w) for w in words]
                del words
                flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
                new = {"n_words": pa.array(sizes, pa.int64()), "runs": listed,
                       "collapsed_text": pa.array([_kept(t, r, n) for t, r, n in zip(texts, runs, sizes)], pa.string())}
                yield with_columns(batch.slice(lo, hi - lo), new)
    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed_text``.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. ``runs`` lists every stretch (``start`` in words
    from 0, ``length``, ``period``) whose smallest period is ``period``, that has ``least`` words and ``times`` periods
    or more, and that no neighbouring word extends; by start, then period. ``collapsed_text`` holds, with one space between,
    the words that no run contains after its first period. Each text is judged alone, so equal and repeated rows
    get equal results. Null, empty and wordless texts have no words, no runs and the empty text; texts of fewer than
    ``least`` words have no runs. A text is held as about 60 bytes per word. An empty table gives no rows. Columns of
    ``docs`` with the three new names are replaced, all others pass.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    shipped(docs.sparkSession)
    own = docs.drop("n_words", "runs", "collapsed_text")
    run = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", run),
                           T.StructField("collapsed_text", T.StringType())])
    return own.mapInArrow(_find(own.columns.index(text_col), least, times), schema)
