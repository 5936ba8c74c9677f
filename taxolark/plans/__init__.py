"""Registered queries: importing a module of plans registers its queries."""

from __future__ import annotations

from taxolark.plans import graphs, indexes, searching, semantics, service, structure
from taxolark.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["all_queries", "all_sql", "graphs", "indexes", "searching", "semantics", "service", "structure"]
