"""All registered queries."""

from __future__ import annotations

from . import report_queries, rule_queries, session_queries, text_queries, verdict_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "request_verdict"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
