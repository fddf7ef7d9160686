"""Queries of the library's own operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audit, graph, lexical, parsed, paths, records, resampling, statistics, store, streams, trees

_PARTS = (statistics, records, resampling, paths, store, lexical, parsed, graph, audit, trees, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.pairwise_tests(spark, sf_dir)


def _catalogue() -> dict[str, tuple]:
    return {name: x for part in _PARTS for name, x in part.catalogue().items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
