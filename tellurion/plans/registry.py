"""All queries of the library by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules with QUERIES and SQL, one for each family of operators.
FAMILIES = ("metric_queries", "telemetry_queries", "warehouse_queries", "usage_queries", "stream_queries", "builtin_queries")

FLAGSHIP = "b06_rate_sum_by_type"


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in FAMILIES:
        found |= import_module(f"tellurion.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in FAMILIES:
        found |= import_module(f"tellurion.plans.{name}").SQL
    return found
