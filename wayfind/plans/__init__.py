"""Registered queries and their SQL."""

from wayfind.plans import documents, graphs, questions, records, relational, vectors  # noqa: F401
from wayfind.plans.registry import ORACLE_SQL, QUERIES
from wayfind.plans.relational import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
