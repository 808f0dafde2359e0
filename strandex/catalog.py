"""Queries of the index engine by name, with the SQL that states each result."""

from __future__ import annotations

from strandex.plans import index, scalar

QUERIES: dict = {**scalar.QUERIES, **index.QUERIES}
ORACLE_SQL: dict[str, str] = {**scalar.ORACLE_SQL, **index.ORACLE_SQL}
