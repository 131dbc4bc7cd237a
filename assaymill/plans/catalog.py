"""All registered queries, in one mapping."""

from assaymill.plans import (  # noqa: F401
    agreement_queries,
    corpus_queries,
    event_queries,
    fit_queries,
    pixel_queries,
    report_queries,
    score_queries,
)
from assaymill.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
