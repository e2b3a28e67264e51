"""Queries over the given tables, one or more for each operator, with their SQL twins."""

from keysnap.queries.oracle import oracle_sql
from keysnap.queries.registry import queries

__all__ = ["oracle_sql", "queries"]
