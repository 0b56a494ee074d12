"""The engine's queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import documents, operations, tables

QUERIES: dict = documents.QUERIES | tables.QUERIES | operations.QUERIES
ORACLE_SQL: dict[str, str] = documents.ORACLE_SQL | tables.ORACLE_SQL | operations.ORACLE_SQL
