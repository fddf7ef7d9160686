"""Writers of ledgers, event stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ledger(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    """A ledger as CSV with a header: its columns in order, others left out, arrays joined by |. one_file is for small reports."""
    kinds = dict(df.dtypes)
    out = df.select(*(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns))
    (out.coalesce(1) if one_file else out).write.csv(path, header=True, mode="overwrite")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, sep="\t", mode="overwrite")


def write_records(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.json(path, mode="overwrite")


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """An event store: a Parquet folder a table."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}", mode="overwrite")


def open_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a store, also as temporary views."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
    return tables


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of repeated keys in new one row."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old with the rows of new in the place of those of their keys; of repeated keys the last by order."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in old.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(last.select(old.columns))


def summary_rows(counts: dict[str, DataFrame], corpus: str) -> DataFrame:
    """corpus, metric and value: the rows of each table, counted in one job each."""
    spark = next(iter(counts.values())).sparkSession
    out = None
    for name, df in counts.items():
        part = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(corpus).alias("corpus"), F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "corpus string, metric string, value string")
