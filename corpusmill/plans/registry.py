"""Every registered query of the library's own operators, with its SQL where SQL can say it."""

from __future__ import annotations

from . import corpus_queries, scalar_queries, search_queries

_MODULES = [scalar_queries, corpus_queries, search_queries]

FLAGSHIP = "r8_context_packages"


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
