"""All queries of the fraud-detection and underwriting part, with their SQL."""

from __future__ import annotations

from vettra.plans import documents, intake, learning, packets, rasters, reviews, scoring, sinks

PARTS = (scoring, documents, packets, reviews, rasters, sinks, learning, intake)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
