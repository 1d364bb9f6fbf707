"""Shared pieces of the checking SQL (DuckDB): the bindings as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

RAW = """raw AS (
  SELECT event_id, ts, value AS p,
         CASE WHEN event_type = 'click' THEN value END AS s1,
         CASE WHEN event_type = 'view' THEN value END AS s2,
         CASE WHEN event_type = 'purchase' THEN value END AS s3,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 - 10 AS temp,
         CAST(event_id % 11 AS DOUBLE) / 10 AS occ,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_type
  FROM events)"""

GAPPY_RAW = """gappy AS (
  SELECT event_id, ts, CASE WHEN k >= 10 THEN p END AS p, CAST(k AS DOUBLE) AS temp FROM raw)"""

COLS = ("p", "s1", "s2", "s3", "temp", "occ")
NAMES = dict(zip(COLS, ("Global_active_power", "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
                        "temperature_c", "occupancy")))


def hourly_from(source: str, name: str = "hourly") -> str:
    """Hourly table of the six measures with an hour ordinal ``o``."""
    return f"""{name}_obs AS (
  SELECT date_trunc('hour', ts) AS ts, avg(p) AS p, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3,
         avg(temp) AS temp, avg(occ) AS occ
  FROM {source} GROUP BY 1),
{name}_grid AS (
  SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {name}_obs),
{name} AS (
  SELECT g.ts, p, coalesce(s1, 0.0::DOUBLE) AS s1, coalesce(s2, 0.0::DOUBLE) AS s2,
         coalesce(s3, 0.0::DOUBLE) AS s3, temp, occ, row_number() OVER (ORDER BY g.ts) - 1 AS o
  FROM {name}_grid g LEFT JOIN {name}_obs b ON g.ts = b.ts)"""


HOURLY = RAW + ",\n" + hourly_from("raw")

BY_TYPE = """typed_obs AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS p
  FROM events GROUP BY 1, 2),
typed_grid AS (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM typed_obs GROUP BY 1),
typed AS (
  SELECT g.series_id, g.ts, p, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS o
  FROM typed_grid g LEFT JOIN typed_obs b ON g.series_id = b.series_id AND g.ts = b.ts)"""

DAILY = """daily_obs AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_quantity) AS p
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
daily_grid AS (
  SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily_obs),
daily AS (
  SELECT g.ts, p FROM daily_grid g LEFT JOIN daily_obs b ON g.ts = b.ts),
days AS (
  SELECT ts, p, row_number() OVER (ORDER BY ts) - 1 AS o, count(*) OVER () AS n
  FROM daily WHERE p IS NOT NULL)"""

GAPPY = HOURLY + """,
gaps AS (
  SELECT ts, o, CASE WHEN o BETWEEN 0 AND 2 OR o BETWEEN 100 AND 158 OR o BETWEEN 200 AND 259
                       OR o BETWEEN 300 AND 360 OR o BETWEEN 400 AND 519 OR o BETWEEN 717 AND 719
                     THEN NULL ELSE p END AS p
  FROM hourly)"""

HOURS = HOURLY + """,
hours AS (
  SELECT ts, p, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n
  FROM hourly WHERE p IS NOT NULL)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    """Rounded as :func:`gridtide.queries.registry.r` does, without a negative zero."""
    out = f"round(CAST({expr} AS DOUBLE) + {0.03 * 10.0 ** -digits!r}::DOUBLE, {digits}) + 0.0::DOUBLE"
    return f"{out} AS {alias}" if alias else out


def fill(source: str, name: str, cols: Sequence[str], *, limit: int | None = None,
         edges: str = "both", part: str = "", keep: str = "ts, o") -> str:
    """Forward fill up to ``limit`` rows (if any), then a line between known neighbours."""
    by = f"PARTITION BY {part} " if part else ""
    keep = f"{part}, {keep}" if part else keep
    held = ", ".join(
        (f"coalesce({c}, last_value({c} IGNORE NULLS) OVER ({by}ORDER BY o "
         f"ROWS BETWEEN {limit} PRECEDING AND 1 PRECEDING))" if limit else c) + f" AS w_{c}" for c in cols)
    upto = f"OVER ({by}ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    onward = f"OVER ({by}ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = ", ".join(
        f"w_{c}, last_value(w_{c} IGNORE NULLS) {upto} AS x0_{c}, "
        f"last_value(CASE WHEN w_{c} IS NOT NULL THEN o END IGNORE NULLS) {upto} AS o0_{c}, "
        f"first_value(w_{c} IGNORE NULLS) {onward} AS x1_{c}, "
        f"first_value(CASE WHEN w_{c} IS NOT NULL THEN o END IGNORE NULLS) {onward} AS o1_{c}" for c in cols)
    lead = "x1_{c}" if edges == "both" else "NULL"
    done = ", ".join(
        f"coalesce(w_{c}, CASE WHEN x0_{c} IS NULL THEN {lead.format(c=c)} WHEN x1_{c} IS NULL THEN x0_{c} "
        f"ELSE x0_{c} + (x1_{c} - x0_{c}) * (o - o0_{c}) / (o1_{c} - o0_{c}) END) AS {c}" for c in cols)
    return f"""{name}_held AS (SELECT {keep}, {held} FROM {source}),
{name}_near AS (SELECT {keep}, {near} FROM {name}_held),
{name} AS (SELECT {keep}, {done} FROM {name}_near)"""


def named(cols: Sequence[str], digits: int = 6) -> str:
    return ", ".join(r(c, digits, NAMES[c]) for c in cols)
