"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base


def _load() -> None:
    if base.QUERIES:
        return
    from . import graph_queries, retrieval_queries, rollup_queries, scalar_queries, search_queries, sequence_queries, stream_queries  # noqa: F401

    scalar_queries.register()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
