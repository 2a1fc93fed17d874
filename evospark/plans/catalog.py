"""All registered queries."""

from __future__ import annotations

from evospark.plans import analyses, ingests, lineages, mutation_reports, reports, stored_runs  # noqa: F401
from evospark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
