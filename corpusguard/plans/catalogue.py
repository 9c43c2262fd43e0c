"""Every query over the given tables, with the SQL that states its result."""

from __future__ import annotations

from corpusguard.plans import investigation, reports, scanned, scans, snapshots, standards, trees, web, words  # noqa: F401
from corpusguard.plans.registry import ORACLE_SQL, QUERIES
from corpusguard.plans.scans import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
