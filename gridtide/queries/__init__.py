"""Registered queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from gridtide.queries import (anomaly, cleaning, diagnostic, evaluation, feature, fitted, forecasting,
                              quality, resampling, source, split)  # noqa: F401
from gridtide.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
