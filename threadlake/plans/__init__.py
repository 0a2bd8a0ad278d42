"""Registered queries with the SQL that says the same."""

from threadlake.plans import search, services, store, streams, text  # noqa: F401
from threadlake.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
