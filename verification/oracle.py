"""Collects one ANSI statement per query, prefixed with the derived relations it needs."""

from __future__ import annotations

import re
from importlib import import_module

from shelfsight.plans.derived_sql import DERIVED, dependencies, for_duckdb

_MODULES = (
    "oracle_catalog", "oracle_sources", "oracle_discovery", "oracle_candidates",
    "oracle_recipes", "oracle_raster", "oracle_lifecycle", "oracle_jobs",
)


def complete(sql: str) -> str:
    """Put the derived relations in front of a SELECT or WITH statement."""
    sql = sql.strip()
    needed = [f"{d} as ({for_duckdb(DERIVED[d]).strip()})" for d in dependencies(sql)]
    own = re.match(r"with\s+(recursive\s+)?", sql)
    if own:
        sql = sql[own.end():]
        return "with recursive " + ",\n".join(needed + [sql])
    return ("with " + ",\n".join(needed) + "\n" + sql) if needed else sql


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        for name, sql in import_module(f"verification.{module}").ORACLES.items():
            out[name] = complete(sql)
    return out
