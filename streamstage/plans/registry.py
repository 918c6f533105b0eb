"""All queries of the engine and their SQL."""

from __future__ import annotations

from streamstage.plans import dataflow, measures, offline  # noqa: F401  each registers its queries

QUERIES = dataflow.QUERIES
ORACLE_SQL = dataflow.ORACLE
