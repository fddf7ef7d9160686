"""Cells: counts of labelled observations by partition (corpus) and key, their rates, intervals and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.keys import LABELS


def cell_counts(df: DataFrame, by: list[str], label: str = "gold_label", unlabelled: str = "drop") -> DataFrame:
    """support, gold_positive and gold_negative of each cell. unlabelled: drop rows of other labels, or count them as negative.
    One aggregation, summed up before the shuffle; rows with a null in by drop out."""
    if unlabelled not in ("drop", "negative"):
        raise ValueError("unlabelled is drop or negative")
    rows = df.dropna(subset=by)
    if unlabelled == "drop":
        rows = rows.filter(F.col(label).isin(*LABELS))
    positive = F.count_if(F.col(label) == "positive")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("support"), positive.alias("gold_positive"), (F.count(F.lit(1)) - positive).alias("gold_negative"))


def with_rates(cells: DataFrame) -> DataFrame:
    """Cells with cpr, the positive rate, and its Wilson bounds."""
    low, high = S.wilson(F.col("gold_positive"), F.col("support"))
    return cells.withColumns({"cpr": S.ratio(F.col("gold_positive"), F.col("support")), "wilson_low": low, "wilson_high": high})


def with_consistency(cells: DataFrame, isolated_share: float = 0.25) -> DataFrame:
    """Cells with minority, label_entropy and kind: unanimous, isolated (the minority is at most isolated_share of the support) or split."""
    minority = F.least("gold_positive", "gold_negative")
    kind = F.when(minority == 0, "unanimous").when(minority <= isolated_share * F.col("support"), "isolated").otherwise("split")
    return cells.withColumns({"minority": minority, "label_entropy": S.entropy(S.ratio(F.col("gold_positive"), F.col("support"))), "kind": kind})


def profile(cells: DataFrame, by: list[str], min_support: int = 5) -> DataFrame:
    """Of each group of cells: firings in cells of enough support, those in mixed cells and their share, and the cells by kind."""
    kinds = with_consistency(cells.filter(F.col("support") >= min_support))
    mixed = F.coalesce(F.sum(F.when(F.col("kind") != "unanimous", F.col("support"))), F.lit(0))
    out = kinds.groupBy(*by).agg(
        F.sum("support").alias("evaluable_firings"),
        mixed.alias("mixed_firings"),
        F.count(F.lit(1)).alias("assessable_cells"),
        *(F.count_if(F.col("kind") == k).alias(f"{name}_cells") for k, name in (("unanimous", "unanimous"), ("isolated", "isolated_contrary"), ("split", "split"))),
    )
    return out.withColumn("mixed_firing_share", S.ratio(F.col("mixed_firings"), F.col("evaluable_firings")))


def first_of_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank. Spark keeps n rows a group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def examples(df: DataFrame, by: list[str], order: str, item: str, n: int = 5, label: str = "gold_label") -> DataFrame:
    """The first n items of the majority and of the contrary label of each mixed cell, in input order (ties go to positive)."""
    binary = df.dropna(subset=by).withColumn("_label", F.when(F.col(label) == "positive", "positive").otherwise("negative"))
    counts = cell_counts(df, by, label, "negative").filter("gold_positive > 0 AND gold_negative > 0")
    counts = counts.withColumn("_major", F.when(F.col("gold_positive") >= F.col("gold_negative"), "positive").otherwise("negative")).select(*by, "_major")
    firsts = first_of_group(binary, [*by, "_label"], [order], n)
    side = F.when(F.col("_label") == F.col("_major"), "majority").otherwise("contrary")
    rows = firsts.join(counts, by).withColumn("side", side)
    return rows.groupBy(*by, "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("items"))
