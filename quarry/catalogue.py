"""Every registered query with the SQL that states the same result."""

from __future__ import annotations

from quarry.plans import content, corpus, dedup, evidence, relational, retrieval, state, text  # noqa: F401  each registers its queries
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
