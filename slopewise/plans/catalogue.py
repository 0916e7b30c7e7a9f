"""All queries of the street-network engine, by name, and the SQL that must agree with them."""

from __future__ import annotations

from slopewise.plans import build, checks, details, extras, heights, layers, lookup, routing, streets, terrain  # noqa: F401
from slopewise.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
