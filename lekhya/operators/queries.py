"""All queries of the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lekhya.operators import chunking_queries, judging_queries, lifecycle_queries, metric_queries, retrieval_queries, statistics_queries, streaming_queries, summary_queries, text_queries  # noqa: F401
from lekhya.operators.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
