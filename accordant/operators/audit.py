"""The pattern audit: evidence of several kinds consolidated by trigger and chain, with a headline by priority.

evidence has a row a form of a pattern: trigger, chain, evidence (its kind), pattern (a number; patterns count in its order), form, trigger_type, key,
total, gold_positive, gold_negative, mention_observations, event_occurrences and agreement (as the kind defines it). Three aggregations roll it up: to patterns, to chains by kind, and to triggers
by kind; each shuffles what the one before it left. Counts are summed; an agreement that was given stays only while a chain's first pattern is alone in its
kind, else it is positives by total. What is nested has a row a kind (five), a form or an example (at most EXAMPLES); realizations, of which there
may be any number, are a table of their own.

An empty trigger is `(no lexical trigger)`. A null count is 0, a null text ''. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import first_of_group
from .ledgers import first_text

# The kinds of evidence, the first that is there giving the headline.
PRIORITY = ("structural", "relational_statement", "lexicalized_path", "candidate_pattern_ledger", "event_without_final_pair")
NO_TRIGGER = "(no lexical trigger)"
COUNTS = ("total", "gold_positive", "gold_negative", "mention_observations", "event_occurrences")
EXAMPLES = 3


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({"trigger": first_text(F.coalesce("trigger", F.lit("")), F.lit(NO_TRIGGER)), "chain": F.coalesce("chain", F.lit(""))})


def _sums() -> list[Column]:
    return [F.sum(F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in COUNTS]


def _ratio() -> Column:
    return F.round(F.coalesce(F.try_divide("gold_positive", "total"), F.lit(0.0)), 4)


def _priority(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, i) for i, k in enumerate(PRIORITY)), F.lit(len(PRIORITY)))


def _stats(*more: str) -> Column:
    return F.struct(*more, *COUNTS, "agreement")


def _rolled(rows: DataFrame, by: list[str], chain: list[str]) -> DataFrame:
    """rows (patterns or forms of them) summed by by; the given agreement stays where one row is alone and its pattern is the chain's first."""
    out = rows.groupBy(*by).agg(*_sums(), F.count(F.lit(1)).alias("_n"), F.min("pattern").alias("_first"), F.first("agreement").alias("_given"))
    first = F.min("_first").over(Window.partitionBy(*chain))  # a row a kind, or a form of it
    return out.withColumn("agreement", F.when((F.col("_n") == 1) & (F.col("_first") == first), F.col("_given")).otherwise(_ratio())).drop("_n", "_first", "_given")


def consolidated_chains(evidence: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """A row a trigger and chain: evidence (its kinds), trigger_types, by_evidence and observed (sorted arrays), headline (the statistics of the first kind) and examples."""
    chain = ["trigger", "chain"]
    forms = _clean(evidence).withColumn("agreement", F.round("agreement", 4))
    patterns = forms.groupBy(*chain, "evidence", "pattern").agg(*_sums(), F.count(F.lit(1)).alias("_n"), F.first("agreement").alias("_given")).withColumn("agreement", F.when(F.col("_n") == 1, F.col("_given")).otherwise(_ratio()))
    kinds = _rolled(patterns, [*chain, "evidence"], chain)
    seen = _rolled(forms, [*chain, "evidence", "form"], chain)
    types = forms.groupBy(*chain).agg(F.array_sort(F.collect_set(F.when(F.col("trigger_type") != "", F.col("trigger_type")))).alias("trigger_types"))
    out = kinds.groupBy(*chain).agg(F.array_sort(F.collect_list(_stats("evidence"))).alias("by_evidence"), F.min_by(_stats("evidence"), _priority(F.col("evidence"))).alias("headline"))
    observed = seen.groupBy(*chain).agg(F.array_sort(F.collect_list(_stats("evidence", "form"))).alias("observed"))
    out = out.withColumn("evidence", F.transform("by_evidence", lambda x: x["evidence"])).join(types, chain).join(observed, chain)
    if examples is None:
        return out
    once = _clean(examples).groupBy(*chain, "sentence_id", "pair").agg(F.min(F.struct("pattern", "ordinal")).alias("_at"), F.min_by("status", F.struct("pattern", "ordinal")).alias("status"))
    few = first_of_group(once, chain, ["_at", "sentence_id"], EXAMPLES).groupBy(*chain).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence_id", "pair", "status"))), lambda x: F.struct(x["sentence_id"], x["pair"], x["status"])).alias("examples"))
    return out.join(few, chain, "left")


def realizations(evidence: DataFrame) -> DataFrame:
    """The keys of each trigger and chain, in order: those of more observations first within a pattern."""
    at = Window.partitionBy("trigger", "chain").orderBy("pattern", F.desc("total"), "key", "form")
    return _clean(evidence).select("trigger", "chain", "pattern", "key", "form", *COUNTS, "agreement").withColumn("place", F.row_number().over(at))


def trigger_list(chains: DataFrame) -> DataFrame:
    """A row a trigger: its kinds, types, number of patterns, statistics by kind and headline, in reading order: those with structural evidence, with
    relational statements, others; unnamed ones last; then by the headline's total, greatest first, and name."""
    rows = chains.select("trigger", F.explode("by_evidence").alias("s")).select("trigger", "s.*").groupBy("trigger", "evidence").agg(*_sums()).withColumn("agreement", _ratio())
    out = rows.groupBy("trigger").agg(F.array_sort(F.collect_list(_stats("evidence"))).alias("by_evidence"), F.min_by(_stats("evidence"), _priority(F.col("evidence"))).alias("headline"))
    about = chains.groupBy("trigger").agg(F.count(F.lit(1)).alias("patterns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("trigger_types")))).alias("trigger_types"))
    out = out.join(about, "trigger").withColumn("evidence", F.transform("by_evidence", lambda x: x["evidence"]))
    group = F.when(F.array_contains("evidence", "structural"), 0).when(F.array_contains("evidence", "relational_statement"), 1).otherwise(2)
    return out.withColumn("reading_group", group).orderBy("reading_group", F.col("trigger") == NO_TRIGGER, F.desc("headline.total"), "trigger")


def pattern_list(chains: DataFrame) -> DataFrame:
    """The chains in the order in which a trigger lists them."""
    return chains.orderBy("trigger", F.desc("headline.total"), "chain")
