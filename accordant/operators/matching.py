"""Matched strata: how far partitions differ within strata of equal construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def carrier_features(df: DataFrame, by: list[str], word: str) -> DataFrame:
    """Distinct carrier words of each group, sorted, joined by +."""
    return df.filter(F.col(word).isNotNull()).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(word)), "+").alias("carriers"))


def with_carriers(df: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    return df.join(features, by, "left").withColumn("carriers", F.coalesce("carriers", F.lit("none")))


def capped(df: DataFrame, column: str, order: str, n: int = 25, other: str = "OTHER") -> DataFrame:
    """df with all but the n most frequent values of a column as other; ties go to the value met first. The n values are broadcast."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).orderBy(F.desc("_n"), "_first").limit(n).select(column, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), column, "left").withColumn(column, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")


def stratum_rates(df: DataFrame, stratum: list[str], partition: str, positive: str, min_rows: int = 5) -> DataFrame:
    """Rows and positive rate of each stratum and partition with enough rows."""
    rows = df.groupBy(*stratum, partition).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(positive).cast("double")).alias("rate"))
    return rows.filter(F.col("n") >= min_rows)


def stratum_gaps(rates: DataFrame, stratum: list[str]) -> DataFrame:
    """The range of rates in each stratum that two partitions or more share."""
    out = rates.groupBy(*stratum).agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("rows"), (F.max("rate") - F.min("rate")).alias("gap"))
    return out.filter(F.col("partitions") >= 2)


def gap_summary(gaps: DataFrame, big: float = 0.3) -> DataFrame:
    return gaps.agg(
        F.count(F.lit(1)).alias("strata"), F.avg("gap").alias("mean_gap"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY gap)").alias("median_gap"),
        S.ratio(F.count_if(F.col("gap") >= big), F.count(F.lit(1))).alias("share_big"),
    )


def mean_gap_by_base(gaps: DataFrame, base: list[str]) -> DataFrame:
    """Mean over base strata of the mean gap of the finer strata in each."""
    return gaps.groupBy(*base).agg(F.avg("gap").alias("gap")).agg(F.count(F.lit(1)).alias("bases"), F.avg("gap").alias("mean_gap"))


def signed_contrast(rates: DataFrame, stratum: list[str], partition: str, a: str, b: str) -> DataFrame:
    """Mean, sample deviation and mean size of rate(b) - rate(a) over the strata that have both."""
    side = lambda x: F.max(F.when(F.col(partition) == x, F.col("rate")))
    both = rates.filter(F.col(partition).isin(a, b)).groupBy(*stratum).agg((side(b) - side(a)).alias("d")).filter("d IS NOT NULL")
    return both.agg(F.count(F.lit(1)).alias("strata"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"), F.avg(F.abs("d")).alias("mean_abs_d"))


def common_strata(levels: list[DataFrame], base: list[str]) -> DataFrame:
    """Base strata that every level has."""
    out = levels[0].select(*base).distinct()
    for x in levels[1:]:
        out = out.intersect(x.select(*base))
    return out
