"""All queries of the library, gathered from the modules that register them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.queries import ORACLE, QUERIES
from quire.registered import jobs as _jobs, projection as _projection, relational as _relational, reports as _reports, search_graph as _search_graph, streams as _streams, text as _text  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid passage search: lexical and vector candidates of every query, fused."""
    return QUERIES["ret4_hybrid_passages"](spark, sf_dir)
