"""Queries over the driver's tables with their SQL twins."""

from suite import documents, library, search, texts, upkeep  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
