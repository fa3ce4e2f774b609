"""Registered queries, with the SQL that says the same."""

from . import coverage, families
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "coverage", "families"]
