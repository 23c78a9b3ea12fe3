"""Registered queries of the knowledge store, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import flows, graphs, listing, ranking, textual  # noqa: F401  they fill the registry
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
