"""All queries of the audit engine."""

from __future__ import annotations

from marginalia.plans import comments, heads, hooks, sessions, sweeps, text  # noqa: F401
from marginalia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
