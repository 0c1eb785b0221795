"""All core queries and their SQL."""

from __future__ import annotations

from lakeassay.plans import reference, reference_sql, training, training_sql

QUERIES = reference.QUERIES | training.QUERIES
ORACLES: dict[str, str] = reference_sql.ORACLES | training_sql.ORACLES
