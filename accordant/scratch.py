"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A folder within spark.checkpoint.dir; where that is unset, one of our own on a local master alone, as other machines couldn't read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named}/accordant"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="accordant-"))
    return _own[0]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and reread: what reads it many times computes it once, and a lost executor costs a reread."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, already: bool = False) -> DataFrame:
    """Like kept, in as many buckets by key as shuffles have partitions: grouping by key and more needs no shuffle then, nor do joins within
    `co_located`. already says that df comes from such tables alone, by steps that left its rows where they were; then it isn't shuffled before it is written."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    rows = df if already else df.repartition(n, key)
    rows.write.bucketBy(n, key).option("compression", "zstd").option("path", f"{folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


#: Joins take both sides as they lie if they are partitioned alike by some of their columns (Spark otherwise wants all); buckets are read as buckets
#: everywhere; and no side is broadcast unless a hint says so, as a merge of what lies together moves nothing.
_CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}
#: Rows that are sorted by what groups them are grouped in one pass, without partial results.
_ONE_PASS = {"spark.sql.execution.replaceHashWithSortAgg": "true"}


@contextmanager
def co_located(spark: SparkSession, one_pass: bool = False) -> Iterator[None]:
    """Settings for joins of tables that are dealt by one key, undone at its end. What is planned within must be computed within, so a result that leaves it is kept."""
    settings = _CO_LOCATED | (_ONE_PASS if one_pass else {})
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def by_sentence(query: Callable[[SparkSession, str], DataFrame] | None = None, *, one_pass: bool = False) -> Callable:
    """A query over tables dealt by sentence, whose joins are co-located and whose result is kept; one_pass: its sorted rows are grouped in one pass."""
    if query is None:
        return lambda query: by_sentence(query, one_pass=one_pass)

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with co_located(spark, one_pass):
            return kept(query(spark, sf), "result")

    return run
