"""All analytics queries: name -> (spark, sf_dir) -> DataFrame, and SQL for the same rows."""

from __future__ import annotations

from segrec.plans import audit, features, methods, quality, ranking, segments, serving, stores  # noqa: F401  they register their queries
from segrec.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
