"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import more_queries  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "grade_mixed_sheet"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
