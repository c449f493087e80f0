"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL."""

    def put(run: Query) -> Query:
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return put


def _load() -> None:
    from folioscope.plans import corpus_queries, graph_queries, more_queries, summary_queries, text_queries  # noqa: F401  registering is what they do


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ranked_subgraph"](spark, sf_dir)
