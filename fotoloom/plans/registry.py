"""Every query of the engine's core with the SQL that states its result."""

from __future__ import annotations

from fotoloom.plans import activity, album_queries, gallery_queries

_MODULES = (activity, gallery_queries, album_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
