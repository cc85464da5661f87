"""Every runnable query of the package with, where SQL can express it, the same query for DuckDB."""

from __future__ import annotations

import importlib

from eventwarden.registry.base import QUERIES, SQL

_MODULES = ["predicates", "detection", "cases", "dashboards", "investigation", "normalization", "text", "streams", "sinks", "pipeline"]


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
