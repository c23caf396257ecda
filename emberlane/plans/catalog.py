"""Registered queries of the telemetry engine and the SQL they are compared with."""

from __future__ import annotations

from . import home_queries, report_queries  # noqa: F401  (they register their queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
