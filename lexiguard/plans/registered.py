"""All registered queries: importing the modules registers theirs."""

from lexiguard.plans import emerging_queries, queries, source_queries, stream_queries, workflow_queries
from lexiguard.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "emerging_queries", "queries", "source_queries", "stream_queries", "workflow_queries"]
