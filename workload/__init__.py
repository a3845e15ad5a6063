"""Queries over the shared test tables, one per operator, with the same question in SQL."""

from workload import charts, edits, learning, profiling, rows  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
