"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from analystry.registry.book import ORACLES, QUERIES

MODULES = ("rows", "ordering", "scorecard", "statistics", "joins", "sources", "text", "scoring", "models", "jobs")

for _name in MODULES:
    importlib.import_module(f"analystry.registry.{_name}")

__all__ = ["ORACLES", "QUERIES"]
