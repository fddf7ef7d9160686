"""A training-data pipeline over documents: quality rules, language identification, near-duplicate removal, substring
deduplication and packing. Each stage gets all that the one before it kept, written as Parquet and reread.

A null or empty text fails the quality rules and goes there. Texts of any length go through whole. Of equal rows, and of rows of one class
of near copies, one stays; rows without an id are documents like others. Where no document has a
usable label, no language model can be trained and that stage keeps all. An empty table gives an empty table. All columns pass to the
last stage, whatever their names, which returns the packing alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import common, jaccard_forest, language_id, packing, quality_rules, sentence_spans

STAGES = [
    ("quality rules", quality_rules.stage),
    ("language identification", language_id.stage),
    ("n-gram Jaccard join", jaccard_forest.stage),
    ("substring deduplication", sentence_spans.stage),
    ("best-fit packing", packing.stage),
]

#: Language identification and MinHash can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
