"""All registered queries."""

from __future__ import annotations

from checks import load_queries, report_queries, source_queries  # noqa: F401
from checks.registry import CHECKS

__all__ = ["CHECKS"]
