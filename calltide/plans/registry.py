"""All registered queries of the library itself, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calltide.plans import codegraph_queries, graph_queries, relation_queries, rule_queries, shape_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {**rule_queries.QUERIES, **relation_queries.QUERIES, **graph_queries.QUERIES, **codegraph_queries.QUERIES, **text_queries.QUERIES, **source_queries.QUERIES, **shape_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
