"""Contract queries and their oracle SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import documents, geometry, offers, settings, sheets, whole

_PARTS = (documents, offers, sheets, geometry, settings, whole)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
