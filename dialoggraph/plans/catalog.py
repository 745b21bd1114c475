"""All registered queries."""

from . import (  # noqa: F401
    build_queries, candidate_queries, graph_queries, guard_queries, question_queries, turn_queries)
from .registry import QUERIES

__all__ = ["QUERIES"]
