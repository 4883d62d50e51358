"""All registered queries."""

from minutespark.plans import (  # noqa: F401
    failure_queries,
    file_queries,
    html_queries,
    relational_queries,
    scalar_queries,
    search_queries,
    segment_queries,
    sink_queries,
    state_queries,
    stream_queries,
)
from minutespark.plans.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
