"""Named queries: operators composed over the driver tables."""

from curul.plans import (  # noqa: F401
    audit_queries,
    author_queries,
    event_queries,
    load_queries,
    page_queries,
    search_queries,
    text_queries,
)
from curul.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
