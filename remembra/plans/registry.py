"""All queries of the memory store, and their SQL."""

from __future__ import annotations

from remembra.plans import intake, knowledge, search, upkeep

MODULES = (search, upkeep, intake, knowledge)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
