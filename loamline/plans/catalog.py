"""All queries of the library outside its optional subpackages."""

from __future__ import annotations

from loamline.plans import graph_queries, ranking_queries, report_queries, repository_queries, row_queries, search_queries, state_queries, text_queries  # noqa: F401
from loamline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
