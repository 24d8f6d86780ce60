"""Queries on the driver's tables, by family; importing a family registers its queries."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries.
FAMILIES = ("sessions", "texts", "measures", "ledgers", "folds", "joins", "decisions", "reports", "messages", "searches", "tables", "scans", "plugged")


def load_catalog():
    """The catalogue with every family registered."""
    for name in FAMILIES:
        importlib.import_module(f"tessera.plans.{name}")
    return importlib.import_module("tessera.plans.catalog")
