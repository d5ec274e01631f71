"""All registered queries."""

from carefold.plans import (  # noqa: F401
    extraction_queries,
    intake_queries,
    knowledge_queries,
    loader_queries,
    masking_queries,
    report_queries,
    streaming_queries,
    trend_queries,
)
from carefold.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
