"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from gleaner.plans import MODULES  # noqa: F401  registers every query
from gleaner.plans.registry import QUERIES, SQL


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
