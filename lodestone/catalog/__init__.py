"""Every query of the engine outside subpackage llm, with the SQL that checks it."""

from __future__ import annotations

from . import quality, relational, retrieval, scalars, snapshot, sources, structured, timeseries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
