"""All queries of the core, with their oracle SQL."""

from __future__ import annotations

from codestrata.plans import codebase, details, reports, snapshots, sources

MODULES = [snapshots, codebase, sources, reports, details]


def queries() -> dict:
    return {name: call for m in MODULES for name, call in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
