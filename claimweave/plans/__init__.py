"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

from claimweave.plans import analytics, claims, documents, evaluation, evidence, scalars, views

_PARTS = (claims, scalars, documents, analytics, evidence, evaluation, views)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
