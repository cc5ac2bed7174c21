"""Registered queries: each runs on the given tables and names its SQL twin."""

from pagerisk.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
