"""Name -> query and name -> checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def r(name: str, digits: int = 6) -> Column:
    """A column rounded under its own name, so both engines print the same digits.

    Means of decimal readings can lie exactly between two roundings, where the last bit
    decides; the checking SQL shifts by the same small part of the last digit.
    """
    return F.round(F.col(name).cast("double") + 0.03 * 10.0 ** -digits, digits).alias(name)
