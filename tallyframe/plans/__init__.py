"""Registered queries over the driver's tables, and the SQL each must agree with."""

from . import compare_queries, log_queries, loss_queries, metric_queries, source_queries, stats_queries, table_queries, vector_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
