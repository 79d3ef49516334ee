"""All queries of the core library by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from docugauge.plans import analytics, documents, readings

QUERIES: dict = {**analytics.QUERIES, **documents.QUERIES, **readings.QUERIES}
ORACLE_SQL: dict = {**analytics.ORACLE_SQL, **documents.ORACLE_SQL, **readings.ORACLE_SQL}
