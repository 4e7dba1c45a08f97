"""Queries and checks, one entry per operator."""

from __future__ import annotations

import importlib

_MODULES = ["tables_and_columns", "filters", "aggregates", "sqlbox", "quality", "text", "learning"]


def all_queries():
    for module in _MODULES:
        importlib.import_module(f"registry.{module}")
    from registry.base import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
