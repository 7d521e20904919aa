"""All core queries by name."""

from __future__ import annotations

from scanloom.plans import analysis, benchmarks, evaluation, layout, packed, rules

MODULES = (packed, rules, benchmarks, layout, analysis, evaluation)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
