"""Operators over the provided tables, which stand in for a catalog's, each with SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from tapewright.queries.base import ORACLE_SQL, QUERIES

for _name in ("ranking", "titles", "matching", "merges", "planning", "scalars", "reviews", "cases", "texts", "sources", "documents", "flows"):
    import_module(f"tapewright.queries.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
