"""All queries of the library's own operators, by name, and their SQL."""

from __future__ import annotations

from quern.plans import corpora, payloads, texts  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
