"""All registered queries of the library and the SQL that states the same result."""

from __future__ import annotations

from trajecta.plans import batteries, behaviour, features, geometry, models, neighbourhoods, relations, signals_trees  # noqa: F401
from trajecta.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
