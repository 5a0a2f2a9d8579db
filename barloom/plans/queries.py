"""All registered queries and their oracles."""

from __future__ import annotations

from . import bar_queries, matrix_queries, model_queries, report_queries, source_queries, stream_queries, study_queries, tape_queries  # noqa: F401  each registers its own
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
