"""All ready-made queries and their SQL twins."""

from __future__ import annotations

from runlens.plans import experiment_queries, model_queries  # noqa: F401
from runlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
