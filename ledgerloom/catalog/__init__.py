"""Runnable queries: each binds one operator to the given tables."""

from __future__ import annotations

import importlib

from ledgerloom.catalog import registry

MODULES = ("finance", "cleaning", "retrieval", "research", "market", "filings", "news", "discovery", "jobs")


def _load():
    for name in MODULES:
        importlib.import_module(f"ledgerloom.catalog.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
