"""All registered queries."""

from granary.plans import (  # noqa: F401
    queries_forecast,
    queries_fraud,
    queries_geo,
    queries_jobs,
    queries_models,
    queries_planning,
    queries_reports,
    queries_scores,
    queries_sources,
    queries_streaming,
    queries_text,
)
from granary.plans.registry import QUERIES

__all__ = ["QUERIES"]
