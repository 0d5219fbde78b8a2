"""Registered queries: each one with the SQL that must give the same rows."""

from tabulon.registry import (  # noqa: F401
    aggregates, analytics, cleaning, filters, joins, reports, retrieval, storage, texts,
)
from tabulon.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
