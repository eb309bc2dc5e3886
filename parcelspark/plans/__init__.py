"""Named query plans and their DuckDB oracles."""

from . import (ml_queries, model_queries, profile_queries, retrieval_queries,  # noqa: F401
               question_queries, store_queries,
               scoring_queries, text_queries)
from .registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES", "register"]
