"""All queries of the library and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import compliance, corpus, evaluation, logs, pages, relevance, retrieval, state, streams

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, evaluation, relevance, corpus, pages, logs, state, compliance, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every question, by BM25."""
    return retrieval.bm25_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
