"""Records: everything about a sentence in one nested row, from tables that are bucketed by sentence.

`bucketed` writes a table once, dealt and sorted by sentence. Over such tables grouping and joining by sentence need no shuffle, so a record costs a scan of
each table; over others each table is shuffled once. What belongs together within a sentence (a proposal and the plans of its event) is joined in the row.

A sentence without rows in a table has an empty array. Rows of sentences that aren't there go. Arrays are in the order of their fields.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import folder

S = "sentence_id"
# Decisions.
NOT_SELECTED = "not_selected"


def bucketed(df: DataFrame, name: str, buckets: int, key: str = S) -> DataFrame:
    """df as a table of the shared folder, dealt into buckets by key and sorted within them: a file a bucket, however many parts df has."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)


def _gathered(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(S).agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != S)))).alias(name))


def decision(proposal: Column, plans: Column, pair: Column) -> Column:
    """applied if a plan of the proposal's event has its pair among its final ones, else the status of the event's first plan where that is review_only or not_applied, else not_selected."""
    own = F.filter(plans, lambda p: p["source_event_id"] == proposal["source_event_id"])
    status = F.get(own, F.lit(0))["application_status"]
    return F.when(F.exists(own, lambda p: F.array_contains(p["final_pairs"], pair)), "applied").when(status.isin("review_only", "not_applied"), status).otherwise(NOT_SELECTED)


def build(sentences: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """sentences with an array of each table's rows. tables: each has sentence_id and is bucketed like sentences, or shuffled once."""
    out = sentences
    for name, df in tables.items():
        kind = df.drop(S).schema.simpleString()
        out = out.join(_gathered(df, name).hint("merge"), S, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return out


def with_decisions(records: DataFrame, proposals: str = "candidate_relations", plans: str = "projection_plans") -> DataFrame:
    """records whose proposals have a decision each, from the plans beside them."""
    pair = lambda c: F.when(c["pair_a"].isNotNull() & c["pair_b"].isNotNull(), F.struct(F.least(c["pair_a"], c["pair_b"]).alias("a"), F.greatest(c["pair_a"], c["pair_b"]).alias("b")))
    return records.withColumn(proposals, F.transform(proposals, lambda c: c.withField("decision", decision(c, F.col(plans), pair(c)))))
