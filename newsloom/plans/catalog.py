"""Names of the reference operators' queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import content_queries, flow_queries, more_queries, page_queries, queue_queries, staging_queries, text_queries

FLAGSHIP = "intake_source_report"
MODULES = [queue_queries, content_queries, page_queries, more_queries, staging_queries, flow_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the reference's own operators."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns for the keys of queries()."""
    return {k: s for m in MODULES for k, s in m.SQL.items()}
