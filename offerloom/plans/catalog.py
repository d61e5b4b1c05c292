"""All queries of the reference's operators and their SQL, by name."""

from __future__ import annotations

from . import changes, ingest, pages, profiles, records, registry, state, text, warehouse

MODULES = [warehouse, text, pages, state, registry, ingest, profiles, records, changes]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
