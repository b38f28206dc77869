"""Registered queries: each pairs a Spark builder with its DuckDB oracle SQL."""

from .registry import REGISTRY, all_queries, all_oracle_sql  # noqa: F401
