"""Lexicalised paths: signatures, evidence classes and aggregates over mined path rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import first_of_group

# Dependency names and what they are taken for.
DEPENDENCIES = {"obj": "dobj", "obl": "nmod", "pobj": "nmod", "nsubj:pass": "nsubjpass", "csubjpass": "nsubjpass", "csubj": "nsubj"}


def preposition(c: Column) -> Column:
    """Lower-cased; among and between are one; none is `_`."""
    clean = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean == "", "_").when(clean.isin("among", "between"), "between/among").otherwise(clean)


def preposition_signature(prepositions: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(prepositions, preposition))), "+")


def dependency(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in DEPENDENCIES.items() for x in kv))
    clean = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean == "", "_").otherwise(F.coalesce(F.try_element_at(names, clean), clean))


def evidence_status(source: Column, status: Column) -> Column:
    """enabled only for reviewed sources with an enabled status."""
    return F.when((source == "reviewed") & (status == "enabled"), "enabled").when(status == "rejected", "rejected").otherwise("review_only")


def families(rows: DataFrame, signature: list[str], sentence: str, pair: list[str], order: str, gold: Column, examples: int = 5) -> DataFrame:
    """Each signature's distinct (sentence, pair) observations, those that are gold, their share and the first examples. Of repeated observations the first counts."""
    once = first_of_group(rows, [*signature, sentence, *pair], [order], 1).drop("rank")
    counts = once.groupBy(*signature).agg(F.count(F.lit(1)).alias("observations"), F.count_if(gold).alias("agreeing"), F.countDistinct(sentence).alias("sentences"))
    few = first_of_group(once, signature, [order], examples)
    named = few.groupBy(*signature).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", sentence))), lambda x: x[sentence]), ";").alias("examples"))
    return counts.join(named, signature).withColumn("rate", F.round(F.col("agreeing") / F.col("observations"), 4))


def by_semantic_signature(fams: DataFrame, semantic: list[str], surface: str) -> DataFrame:
    """Families of one meaning together: how many, their observations and surface forms."""
    return fams.groupBy(*semantic).agg(
        F.count(F.lit(1)).alias("families"), F.sum("observations").alias("observations"), F.sum("agreeing").alias("agreeing"), F.array_join(F.array_sort(F.collect_set(surface)), ",").alias("surfaces")
    )


def head_classes(rows: DataFrame, head: str, lexicon: DataFrame, order: list[str], default: str = "other") -> DataFrame:
    """rows with head_class: the first class of order whose words have the head. lexicon: word and class; it is grouped to a row
    a word, and joined as Spark sees fit."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("class"))
    best = lexicon.withColumn("_r", rank).filter("_r > 0").groupBy("word").agg(F.min_by("class", "_r").alias("head_class"))
    out = rows.withColumn("_w", F.lower(head)).join(best.withColumnRenamed("word", "_w"), "_w", "left").drop("_w")
    return out.withColumn("head_class", F.coalesce("head_class", F.lit(default)))


def class_signature(rows: DataFrame, by: list[str], word: str, lexicon: DataFrame) -> DataFrame:
    """All classes of all words of a group, sorted, joined by +; `none` for a group without any."""
    known = rows.join(lexicon.select(F.col("word").alias(word), "class").distinct(), word, "left")
    return known.groupBy(*by).agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("class")), "+"), F.lit("")), F.lit("none")).alias("signature"))
