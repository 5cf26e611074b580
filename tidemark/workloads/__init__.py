"""Queries over the shared test tables, each with the SQL that must give the same rows."""

from tidemark.workloads.registry import ORACLES, QUERIES
from tidemark.workloads import (  # noqa: F401  (importing registers the queries)
    analysis, changes, evolution, ingestion, layout, publishing, scans, timetravel, viewing,
)

__all__ = ["ORACLES", "QUERIES"]
