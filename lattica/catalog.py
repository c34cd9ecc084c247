"""All queries and their DuckDB SQL, gathered from the query modules."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, ann, graph, metadata, plans, records, text, vectors  # noqa: F401
