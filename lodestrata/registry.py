"""All queries of the core library, by name."""

from __future__ import annotations

from lodestrata.plans import corpus, graphs, metrics, models

_MODULES = [metrics, graphs, corpus, models]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
