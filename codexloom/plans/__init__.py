"""Named queries over the engine, with the SQL they are checked against."""

from __future__ import annotations

from . import calls, documents, files, reviews, stores, streams, tables, texts  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
