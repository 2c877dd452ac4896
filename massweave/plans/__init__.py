"""Registered queries over the operators."""

from massweave.plans import domain_queries, file_queries, more_queries, peak_queries, survey_queries, table_queries  # noqa: F401
from massweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
