"""Collects every query module."""

from __future__ import annotations

from cellweave.plans import clean_queries, custom_queries, embedding_queries, graph_queries, model_queries, spatial_queries, statistics_queries, summary_queries  # noqa: F401
from cellweave.plans.registry import REGISTRY, oracle_text, spark_callable


def queries():
    return {name: spark_callable(q) for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: oracle_text(q) for name, q in REGISTRY.items() if q.sql}
