"""Reliability of patterns: precision, heterogeneity between partitions, inconsistency tables, coverage of gold pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def pattern_reliability(df: DataFrame, key: list[str], min_count: int = 5) -> DataFrame:
    """total, correct, fp, precision and its interval (four decimals) of each key with enough predictions; correct is 0 or 1."""
    rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("long")).alias("correct")).filter(F.col("total") >= min_count)
    low, high = S.wilson(F.col("correct"), F.col("total"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 4)))
    return rows.withColumns({"fp": F.col("total") - F.col("correct"), "precision": S.ratio(F.col("correct"), F.col("total")), "wilson_low": clamp(low), "wilson_high": clamp(high)})


def semantic_reliability(patterns: DataFrame, key: str, member: str, min_count: int = 5) -> DataFrame:
    """Totals of the patterns of a semantic key, with their names."""
    out = patterns.groupBy(key).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    return out.filter(F.col("total") >= min_count).withColumn("precision", S.ratio(F.col("correct"), F.col("total")))


def channel_counts(df: DataFrame, key: list[str], channel: str) -> DataFrame:
    """A map of the channels of each key to how often each occurs; null and empty ones are `unknown`."""
    name = F.coalesce(F.nullif(F.trim(F.col(channel)), F.lit("")), F.lit("unknown"))
    counts = df.groupBy(*key, name.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_n")))).alias("channels"))


def heterogeneity(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cochran's Q of each key's rates over the partitions, its degrees of freedom, I squared, and whether Q is beyond the 0.95
    quantile (to 6 degrees). Zeros for one partition, or where all labels are one."""
    whole = cells.groupBy(*key).agg(F.sum("gold_positive").alias("_p"), F.sum("support").alias("_n"), F.count(F.lit(1)).alias("partitions"))
    pooled = whole.withColumn("pooled", S.ratio(F.col("_p"), F.col("_n"))).drop("_p", "_n")
    spread = F.col("pooled") * (1 - F.col("pooled"))
    term = F.col("support") * F.pow(S.ratio(F.col("gold_positive"), F.col("support")) - F.col("pooled"), 2) / F.nullif(spread, F.lit(0.0))
    out = cells.join(pooled, key).groupBy(*key, "pooled", "partitions").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("_q"))
    q = F.when(F.col("partitions") >= 2, F.col("_q")).otherwise(0.0)
    df_ = F.when(F.col("partitions") >= 2, F.col("partitions") - 1).otherwise(0)
    out = out.withColumns({"q": q, "df": df_}).drop("_q")
    out = out.withColumn("i_squared", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0))
    limit = F.create_map(*(F.lit(x) for kv in S.CHI_SQUARED_95.items() for x in kv))
    return out.withColumn("heterogeneous", F.coalesce(F.col("q") > F.try_element_at(limit, F.col("df").cast("int")), F.lit(False)))


def inconsistency(cells: DataFrame, key: list[str], partition: str = "corpus", min_count: int = 3, min_partitions: int = 2) -> DataFrame:
    """Of each key in enough partitions: the range of its rates, the partitions at both ends, and whether their intervals are apart."""
    low, high = S.wilson(F.col("gold_positive"), F.col("support"))
    rows = cells.filter(F.col("support") >= min_count).withColumns({"_r": S.ratio(F.col("gold_positive"), F.col("support")), "_lo": low, "_hi": high})
    # Ties go to the lesser name: the least of (rate, name), and of (-rate, name).
    best = F.min_by(F.struct(partition, "_r", "_lo"), F.struct(-F.col("_r"), F.col(partition)))
    worst = F.min_by(F.struct(partition, "_r", "_hi"), F.struct(F.col("_r"), F.col(partition)))
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("partitions"), best.alias("b"), worst.alias("w")).filter(F.col("partitions") >= min_partitions)
    return out.select(*key, "partitions", F.col(f"b.{partition}").alias("highest"), F.col(f"w.{partition}").alias("lowest"), (F.col("b._r") - F.col("w._r")).alias("inconsistency"), (F.col("b._lo") > F.col("w._hi")).alias("apart"))


def sentence_sets(df: DataFrame, sentence: list[str], pair: Column, predicted: Column, gold: Column) -> DataFrame:
    """A row a sentence with its distinct predicted and gold pairs (arrays); gold is null for a sentence without any label."""
    rows = df.withColumns({"_pair": pair, "_p": predicted, "_g": gold})
    return rows.groupBy(*sentence).agg(
        F.array_sort(F.collect_set(F.when(F.col("_p"), F.col("_pair")))).alias("pred_pairs"),
        F.when(F.count("_g") > 0, F.array_sort(F.collect_set(F.when(F.col("_g"), F.col("_pair"))))).alias("gold_pairs"),
    )


def sentence_label(pred: Column, gold: Column) -> Column:
    """no_gold, correct, too_many (all gold and more), too_few (some of gold, nothing else) or wrong_pairs."""
    missing, extra = F.size(F.array_except(gold, pred)) > 0, F.size(F.array_except(pred, gold)) > 0
    return F.when(gold.isNull(), "no_gold").when(~missing & ~extra, "correct").when(~missing, "too_many").when(~extra, "too_few").otherwise("wrong_pairs")


def coverage(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Gold pairs, those predicted, and their share. A null gold counts as none."""
    gold = F.coalesce(F.col("gold_pairs"), F.slice("pred_pairs", 1, 0))
    out = sentences.groupBy(*by).agg(F.sum(F.size(gold)).alias("gold"), F.sum(F.size(F.array_intersect(gold, F.col("pred_pairs")))).alias("covered"))
    return out.withColumn("coverage", S.ratio(F.col("covered"), F.col("gold")))


def confusion(df: DataFrame, by: list[str], predicted: Column, gold: Column) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1 and accuracy; a null counts as negative, an undefined ratio as 0."""
    p, g = F.coalesce(predicted, F.lit(False)), F.coalesce(gold, F.lit(False))
    rows = df.withColumns({"_p": p, "_g": g})
    count = lambda a, b: F.count_if((F.col("_p") == a) & (F.col("_g") == b))
    out = rows.groupBy(*by).agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": S.ratio(tp, tp + fp), "recall": S.ratio(tp, tp + fn), "f1": S.ratio(2 * tp, 2 * tp + fp + fn), "accuracy": S.ratio(tp + tn, tp + fp + fn + tn)})
