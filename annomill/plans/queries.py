"""All queries of the engine's own operators."""

from . import aggregate_queries, join_queries, layout_queries, plan_queries, recognize_queries, record_queries, tree_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
