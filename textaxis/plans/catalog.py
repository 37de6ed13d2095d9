"""The registered queries, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textaxis.plans import corpus_queries, eval_queries, evaluation_queries, policy_queries, record_queries, selection_queries, text_queries, vector_queries

_MODULES = (text_queries, vector_queries, corpus_queries, eval_queries, evaluation_queries, policy_queries, selection_queries, record_queries, evaluation_queries)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.registry.queries
    ORACLES |= _m.registry.oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained items, mean confidence margin and top-five margin by quadrant."""
    return QUERIES["entry_quadrants"](spark, sf_dir)
