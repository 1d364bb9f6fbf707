"""Compare a Spark result with the checking SQL, the way the driver does: order-free, by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v) if v is not None else "null"


def rows_of(names, rows):
    """Rows with cells in column-name order, sorted with the exact columns first."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    floats = {i for r in rows for i in order if isinstance(r[i], float)}
    exact_first = [i for i in order if i not in floats] + [i for i in order if i in floats]
    return [[r[i] for i in order] for r in sorted(rows, key=lambda r: [_cell(r[i]) for i in exact_first])]


def _same(a, b, exact):
    if not exact and isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=2e-6, abs_tol=1.01e-4)
    return _cell(a) == _cell(b)


def difference(df, con, sql: str, exact: bool = True) -> str | None:
    """None when equal, else what differs.

    Display rounding of a value halfway between two digits may fall either way; ``exact=False``
    forgives one unit of the fourth decimal.
    """
    got_names, got = df.columns, [tuple(x) for x in df.collect()]
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not want:
        return "no rows"
    pairs = list(zip(rows_of(got_names, got), rows_of(want_names, want)))
    bad = [(x, y) for x, y in pairs if not all(_same(i, j, exact) for i, j in zip(x, y))]
    return f"{len(bad)} of {len(pairs)} rows differ, first {bad[0]}" if bad else None
