"""Name -> query and name -> DuckDB oracle, gathered from the plan modules."""

from __future__ import annotations

from .plans import dialogues, files, policies, records, search, texts, turns, values

_MODULES = [texts, turns, dialogues, search, policies, values, files, records]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
