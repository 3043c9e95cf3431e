"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from lexiflow.plans import corpus_queries, flagship, more_queries, stats_queries, text_queries, token_queries  # noqa: F401
from lexiflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
