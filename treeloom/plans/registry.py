"""All queries of the library and their SQL."""

from __future__ import annotations

from treeloom.plans import token_queries, tree_queries

MODULES = (token_queries, tree_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
