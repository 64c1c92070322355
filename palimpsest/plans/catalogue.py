"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import cooccurrence_queries, reference_queries, search_queries, text_queries, timestamp_queries, upkeep_queries

MODULES = (reference_queries, timestamp_queries, cooccurrence_queries, text_queries, search_queries, upkeep_queries)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
