"""Collects the queries of every module in this package."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("relational", "search", "joins", "ranking", "ingest", "surface", "feeds")


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
