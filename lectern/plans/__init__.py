"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import page_queries, reading_queries, session_queries, source_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
