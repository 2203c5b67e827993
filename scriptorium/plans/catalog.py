"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from scriptorium.plans import evidence, passages, relations, reports, texts  # noqa: F401
from scriptorium.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "composition_diff"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
