"""Queries of the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from lexarium.plans import answers, conversations, corpus, indexing, ranking, snapshots, vectors
from lexarium.plans.base import ORACLE_SQL, QUERIES

MODULES = (answers, corpus, indexing, ranking, vectors, snapshots, conversations)
__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
