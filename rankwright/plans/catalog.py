"""The registry of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankwright.plans import connectors, evaluation, relational, retrieval, reviews, scalars, texts

_MODULES = [retrieval, relational, texts, evaluation, reviews, connectors, scalars]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_top10"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
