"""Every query on training data with, where SQL can state it, the SQL of its result."""

from __future__ import annotations

import importlib
import importlib.util

_NAMES = ("clusters", "neighbours", "cooccurrence", "runs", "encoding", "packing", "abuse")


def _modules():
    for name in _NAMES:
        if importlib.util.find_spec(f"fotoloom.llm.{name}_queries"):
            yield importlib.import_module(f"fotoloom.llm.{name}_queries")


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in m.SQL.items()}
