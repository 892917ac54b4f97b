"""All registered queries of the knowledge-graph operators, with their DuckDB counterparts."""

from __future__ import annotations

from . import files, graphs, relational, scalar  # noqa: F401
from .tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
