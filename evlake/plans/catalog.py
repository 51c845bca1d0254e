"""All registered queries."""

from __future__ import annotations

from . import change_queries, record_queries, run_queries, source_queries, view_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

FLAGSHIP = "frontier"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
