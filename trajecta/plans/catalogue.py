"""All queries for the operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajecta.plans import batches, catalogs, conversations, environments, histories, layouts, lookups, rollouts, scans, scoring, sequences, texts, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (scans, conversations, texts, sequences, rollouts, batches, catalogs, scoring, environments, training, layouts, histories, lookups):
    QUERIES |= {k: q for k, (q, _) in _part.PLANS.items()}
    ORACLES |= {k: sql for k, (_, sql) in _part.PLANS.items() if sql}
