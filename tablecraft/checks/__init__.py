"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from tablecraft.checks import registry

MODULES = ["flagship", "transforms", "aggregates", "joins", "pivots", "windows", "ordering",
           "logs", "catalog", "relations", "sources", "loads", "streams", "sql"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tablecraft.checks.{name}")


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
