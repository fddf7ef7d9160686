"""Agreement between partitions: exact tests of every pair of partitions that share a key, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def cell_pairs(cells: DataFrame, key: list[str], partition: str = "corpus", min_support: int = 5) -> DataFrame:
    """Pairs of partitions (the lesser name first) with a cell of enough support for the same key. Cells are few and a key has at most one a partition."""
    names = ["gold_positive", "gold_negative", "support"]
    rows = cells.filter(F.col("support") >= min_support).select(*key, partition, *names)

    def side(i: int) -> DataFrame:
        return rows.select(*key, F.col(partition).alias(f"{partition}_{i}"), F.col("gold_positive").alias(f"positive_{i}"), F.col("gold_negative").alias(f"negative_{i}"), F.col("support").alias(f"support_{i}"))

    return side(1).join(side(2), key).filter(F.col(f"{partition}_1") < F.col(f"{partition}_2"))


def pairwise_tests(cells: DataFrame, key: list[str], families: list[str], partition: str = "corpus", min_support: int = 5) -> DataFrame:
    """Each pair with its rates, the difference, Fisher's exact p and the q of Benjamini and Hochberg within each family
    (columns of key). Rates and p count as written with six digits, as published tables have them: the difference and q are of those."""
    pairs = cell_pairs(cells, key, partition, min_support)
    rate = {i: S.six_digits(S.ratio(F.col(f"positive_{i}"), F.col(f"support_{i}"))).cast("double") for i in (1, 2)}
    p = S.six_digits(S.fisher_p("positive_1", "negative_1", "positive_2", "negative_2")).cast("double")
    # Arrow UDFs run once: their results are columns before anything refers to them.
    tests = pairs.withColumns({"cpr_1": rate[1], "cpr_2": rate[2], "p_value": p}).withColumn("cpr_delta_abs", F.abs(F.col("cpr_1") - F.col("cpr_2")))
    return S.benjamini_hochberg(tests, "p_value", "q_value", families, [*key, f"{partition}_1", f"{partition}_2"])


def family_breakdown(tests: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    return tests.groupBy(*family).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("q_value") < alpha).alias("significant"))


def localisation(tests: DataFrame, partition: str = "corpus", alpha: float = 0.05) -> DataFrame:
    """Significant tests of each pair of partitions, most first."""
    pair = [f"{partition}_1", f"{partition}_2"]
    return tests.filter(F.col("q_value") < alpha).groupBy(*pair).agg(F.count(F.lit(1)).alias("significant")).orderBy(F.desc("significant"), *pair)


def significant_overlap(a: DataFrame, b: DataFrame, key: list[str], alpha: float = 0.05) -> DataFrame:
    """Keys that are significant in both runs."""
    return a.filter(F.col("q_value") < alpha).select(*key).intersect(b.filter(F.col("q_value") < alpha).select(*key))


def primary_family(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tests, significant ones, their share, and the mean difference of rates."""
    row = tests.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("q_value") < alpha).alias("significant"), F.avg("cpr_delta_abs").alias("mean_abs_delta"))
    return row.withColumn("significant_share", S.ratio(F.col("significant"), F.col("tests")))
