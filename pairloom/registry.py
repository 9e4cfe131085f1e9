"""All registered queries of the engine: name to function, name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans import anomalies, clusters, evaluations, extras, flows, further, incidents, pairs, records, searches, similarity, structure, texts, trends, writing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for plan in (pairs, incidents, trends, texts, similarity, structure, flows, extras, writing, records, searches, further, anomalies, clusters, evaluations):
    QUERIES |= plan.QUERIES
    SQL |= plan.SQL
