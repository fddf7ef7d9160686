"""Evidence logic: pairs within records, decisions, stages, the coverage waterfall, and time joins within a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In order of priority, as the waterfall counts them.
TIERS = ("clause", "event_nominal", "state", "held", "path", "none")


def all_pairs(n: Column) -> Column:
    """Unordered pairs of 0 .. n-1 as an array of (a, b)."""
    inner = lambda a: F.transform(F.sequence(a + 1, n - 1), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), inner))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def group_pairs(left: Column, right: Column, diagonal: Column) -> Column:
    """Pairs of two groups' members: by position where diagonal (of the shorter length), else each with each."""
    zipped = F.slice(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.lit(1), F.least(F.size(left), F.size(right)))
    crossed = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.when(diagonal, zipped).otherwise(crossed)


def annotate_decisions(proposals: DataFrame, plans: DataFrame, event: list[str], pair: str = "pair") -> DataFrame:
    """Proposals with decision: applied if their event's plan has the pair among final_pairs, else review_only or not_applied as the
    plan's status says; without a plan not_selected. plans: event, status, final_pairs; one row an event."""
    joined = proposals.join(plans.select(*event, F.col("status").alias("_s"), F.col("final_pairs").alias("_f")), event, "left")
    decision = (
        F.when(F.col("_s").isNull(), "not_selected")
        .when(F.coalesce(F.array_contains("_f", F.col(pair)), F.lit(False)), "applied")
        .when(F.col("_s") == "review_only", "review_only")
        .when(F.col("_s") == "not_applied", "not_applied")
        .otherwise("not_selected")
    )
    return joined.withColumn("decision", decision).drop("_s", "_f")


def merge_proposals(df: DataFrame, by: list[str], asserted: Column, relational: Column) -> DataFrame:
    """Of each pair's proposals: is any asserted, are all relational, and how many there are."""
    return df.groupBy(*by).agg(F.bool_or(asserted).alias("asserted"), F.bool_and(relational).alias("relational"), F.count(F.lit(1)).alias("proposals"))


def stage(emitted: Column, proposed: Column, asserted: Column, relational: Column, same_event: Column, both_ends: Column, any_end: Column) -> Column:
    """Where on its way a pair got to: the first of these that holds."""
    steps = [
        ("emitted", emitted),
        ("held_relational", proposed & relational),
        ("held_not_asserted", proposed & ~asserted),
        ("held_proposed", proposed),
        ("same_event_unprojected", same_event),
        ("ends_in_other_events", both_ends),
        ("one_end_in_an_event", any_end),
    ]
    return reduce(lambda c, s: c.when(s[1], s[0]), steps[1:], F.when(steps[0][1], steps[0][0])).otherwise("no_event")


def tier(flags: dict[str, Column]) -> Column:
    """The first tier whose flag is true; none without any."""
    named = [t for t in TIERS if t in flags]
    return F.coalesce(*(F.when(flags[t], F.lit(t)) for t in named), F.lit("none"))


def waterfall(df: DataFrame, by: str, tier_column: str, total: str = "all") -> DataFrame:
    """Rows of each tier, by group and for all together."""
    out = df.groupBy(F.col(by), F.col(tier_column)).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(out.groupBy(tier_column).agg(F.sum("n").alias("n")).withColumn(by, F.lit(total)))


def preceding(events: DataFrame, by: list[str], time: list[str], is_anchor: Column, value: str, name: str) -> DataFrame:
    """Each row with the value of the last anchor row before it in its group."""
    w = Window.partitionBy(*by).orderBy(*time).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(w))


def overlap_groups(df: DataFrame, by: list[str], start: str, end: str, name: str = "group") -> DataFrame:
    """Half-open intervals that overlap, directly or by others between, get the same number: a new group begins where an interval starts at or after the end of all before."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_reach", F.max(end).over(before))
    begins = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0)
    return rows.withColumn("_new", begins).withColumn(name, F.sum("_new").over(upto) - 1).drop("_reach", "_new")


def unambiguous(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that have one value, and it."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def with_fallback(df: DataFrame, exact: DataFrame, exact_key: list[str], loose: DataFrame, loose_key: list[str], value: str) -> DataFrame:
    """df with value from the exact key, else from the loose one where that is unambiguous."""
    one = exact.groupBy(*exact_key).agg(F.min(value).alias("_exact"))
    two = unambiguous(loose, loose_key, value).withColumnRenamed(value, "_loose")
    return df.join(one, exact_key, "left").join(two, loose_key, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, and which."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit("first"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("only_in", F.lit("second"))
    return left.unionByName(right)
