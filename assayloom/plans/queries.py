"""All registered queries."""

from __future__ import annotations

from assayloom.plans import audit_queries, further_queries, last_queries, matrix_queries, model_queries, more_queries, result_queries, study_queries, text_queries  # noqa: F401
from assayloom.plans.registry import ORACLE, QUERIES, entry

__all__ = ["ORACLE", "QUERIES", "entry"]
