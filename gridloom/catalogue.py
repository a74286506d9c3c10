"""All registered queries of the meter operators and their DuckDB counterparts."""

from __future__ import annotations

from .plans import audit_queries, battery_queries, family_queries, io_queries, library_queries, model_queries, relational_queries, series_queries, week_queries  # noqa: F401  (they register themselves)
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "negative_load_evidence"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
