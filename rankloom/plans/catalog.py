"""All queries by name, with their SQL."""

from __future__ import annotations

from . import file_queries, hit_queries, run_queries, text_queries  # noqa: F401
from .hit_queries import flagship  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
