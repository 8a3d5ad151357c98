"""All queries of the core library, by name."""

from . import queries_metrics, queries_rows, queries_runs, queries_tables
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_metrics", "queries_rows", "queries_runs", "queries_tables"]
