"""All registered queries and their check SQL."""

from sitefold.plans import study_queries, table_queries  # noqa: F401  (registration)
from sitefold.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
