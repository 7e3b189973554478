"""Registered queries: one per operator, each with its SQL twin where SQL can express it."""

from tonegap.plans import (  # noqa: F401
    curation_queries,
    evaluation_queries,
    explain_queries,
    io_queries,
    label_queries,
    scoring_queries,
    text_queries,
    vector_queries,
)
from tonegap.plans.registry import QUERIES

__all__ = ["QUERIES"]
