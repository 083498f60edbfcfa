"""The registered queries of the core, gathered from their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeworks import code_queries, compose_queries, domain_queries, graph_queries, history_queries, index_queries, inventory_queries, io_queries, resolve_queries, retrieval_queries, store_queries, text_queries, write_queries

_MODULES = (history_queries, store_queries, text_queries, retrieval_queries, graph_queries, code_queries, domain_queries, inventory_queries, index_queries, io_queries, resolve_queries, write_queries, compose_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.hybrid_search(spark, sf_dir)
