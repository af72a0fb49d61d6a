"""All registered queries."""

from oracle_queries import reads, records, writes  # noqa: F401
from oracle_queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
