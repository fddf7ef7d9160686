"""Classes of carrier words by a codebook: all classes of a word, of a signature of several words, one coarse guess, and what they say of cells.

A codebook is a mapping of class to words, in the order of its classes; the word lists are parameters (`read_codebook` reads them from JSON).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_part

# The codebook's classes, in its order.
CLASSES = (
    "role_entity_carrier",
    "part_entity_carrier",
    "entity_shifting_carrier",
    "relation_nominal",
    "process_layer",
    "attribute_layer",
    "metric_or_expression_layer",
    "pathway_location_layer",
    "assay_reagent_layer",
    "expression_variant_layer",
    "generic_entity_head",
)
# Classes whose word can be the relation's end instead of the marked name.
BOUNDARY = ("role_entity_carrier", "part_entity_carrier", "entity_shifting_carrier")
# The coarse guess of a signature, by the first of these classes that it has.
GUESSES = (
    ("is_the_relation", ("relation_nominal",)),
    ("entity_boundary", BOUNDARY),
    ("assay_layer", ("assay_reagent_layer",)),
    ("expression_or_variant", ("expression_variant_layer",)),
    ("blocks_to_pathway", ("pathway_location_layer",)),
    ("blocks_to_metric", ("metric_or_expression_layer", "attribute_layer")),
    ("process_layer", ("process_layer",)),
    ("generic_head", ("generic_entity_head",)),
)
# Triggers of a physical interaction.
PHYSICAL = ("bind", "interact", "associate", "complex", "dimerize", "heterodimerize", "oligomerize")

Codebook = dict[str, list[str]]


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    """A JSON object of class to words, read through Spark so that any store works; a class that isn't one of CLASSES is an error."""
    book = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    unknown = set(book) - set(CLASSES)
    if unknown:
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    return {c: [w.strip().lower() for w in book[c]] for c in CLASSES if c in book}


def _named(head: Column) -> Column:
    return ~head.isin("", "_", "none")


def _classes(head: Column, book: Codebook) -> Column:
    found = F.array_compact(F.array(*(F.when(head.isin(*book[c]), c) for c in CLASSES if book.get(c)))) if any(book.values()) else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_carrier")))


def head_classes(head: Column, book: Codebook) -> Column:
    """All classes of a word: `none` for no word, `other_carrier` for one that the codebook lacks."""
    clean = F.lower(F.trim(F.coalesce(head, F.lit(""))))
    return F.when(_named(clean), _classes(clean, book)).otherwise(F.array(F.lit("none")))


def _parts(signature: Column) -> Column:
    return F.transform(F.split(F.coalesce(signature, F.lit("")), "[+,]"), lambda x: F.lower(F.trim(x)))


def joint_heads(signatures: Column) -> Column:
    """The distinct words of an array of signatures, which + and , part, as they first stand."""
    return F.array_distinct(F.filter(F.flatten(F.transform(signatures, _parts)), _named))


def joint_classes(signatures: Column, book: Codebook) -> Column:
    """The distinct classes of the words of all signatures of one observation, by the place of their words within a signature, then in the codebook's order; `none` without any word."""
    order = F.array(*map(F.lit, CLASSES))

    def classed(head: Column, place: Column) -> Column:
        each = F.transform(_classes(head, book), lambda c: F.struct(place.alias("place"), F.coalesce(F.nullif(F.array_position(order, c), F.lit(0)), F.lit(len(CLASSES) + 1)).alias("rank"), c.alias("class")))
        return F.when(_named(head), each).otherwise(F.array().cast("array<struct<place:int,rank:bigint,class:string>>"))

    found = F.flatten(F.transform(signatures, lambda s: F.flatten(F.transform(_parts(s), classed))))
    every = F.array_distinct(F.transform(F.array_sort(found), lambda x: x["class"]))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("none")))


def joint_guess(signatures: Column, book: Codebook) -> Column:
    """One coarse label of the signatures of one observation, for stratifying samples."""
    heads, classes = joint_heads(signatures), joint_classes(signatures, book)
    broken = F.exists(heads, lambda h: h.contains("-") | h.rlike(r"protein\d.*protein\d"))
    out = F.when(F.size(heads) == 0, "none").when(broken, "tokenization_artifact")
    for name, some in GUESSES:
        out = out.when(F.arrays_overlap(classes, F.array(*map(F.lit, some))), name)
    return out.otherwise("unknown")


def signature_heads(signature: Column) -> Column:
    """The distinct words of a signature, as they first stand."""
    return joint_heads(F.array(signature))


def signature_classes(signature: Column, book: Codebook) -> Column:
    """The distinct classes of a signature's words, as they first come up; `none` without any word."""
    return joint_classes(F.array(signature), book)


def effect_guess(signature: Column, book: Codebook) -> Column:
    """One coarse label of a signature."""
    return joint_guess(F.array(signature), book)


def coverage(rows: DataFrame, word: str, book: Codebook, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a carrier, those whose word the codebook classes, and their share."""
    classed = ~F.array_contains(head_classes(F.col(word), book), "other_carrier")
    named = rows.filter(~F.array_contains(head_classes(F.col(word), book), "none"))
    out = named.groupBy(*by).agg(F.count(F.lit(1)).alias("carrier_rows"), F.count_if(classed).alias("classed_rows"))
    return out.withColumn("coverage", F.round(F.try_divide("classed_rows", "carrier_rows"), 3))


def carriers_of_cells(carriers: DataFrame) -> DataFrame:
    """The distinct carrier words of each (corpus, key), sorted, and their rows."""
    word = F.lower(F.trim("carrier_word"))
    rows = carriers.filter((word != "") & (F.coalesce("pattern_key", F.lit("")) != ""))
    return rows.groupBy("corpus", F.col("pattern_key").alias("key")).agg(F.array_sort(F.collect_set(word)).alias("carrier_words"), F.count(F.lit(1)).alias("carrier_row_count"))


def physical_candidates(isolated: DataFrame, carriers: DataFrame, boundary: list[str]) -> DataFrame:
    """Isolated-contrary cells (corpus, key) with their pattern's parts, whether they are verbal patterns of a physical trigger (core), and
    whether no carrier of theirs is a boundary word (included) or they have none at all (strict)."""
    parts = {n: key_part(F.col("key"), i) for i, n in enumerate(("evidence_class", "shape", "trigger", "case_marker", "construction"))}
    rows = isolated.withColumns(parts).join(carriers_of_cells(carriers), ["corpus", "key"], "left")
    words = F.coalesce("carrier_words", F.array().cast("array<string>"))
    core = (F.col("evidence_class") == "structural") & (F.col("construction") == "verbal") & F.col("trigger").isin(*PHYSICAL)
    shifting = F.array_intersect(words, F.array(*map(F.lit, boundary)).cast("array<string>"))
    rows = rows.withColumns({"carrier_words": words, "carrier_row_count": F.coalesce("carrier_row_count", F.lit(0)), "entity_shifting_carriers": shifting, "core": core})
    return rows.withColumns({"included_no_entity_shift": F.col("core") & (F.size("entity_shifting_carriers") == 0), "strict_no_carrier_rows": F.col("core") & (F.size("carrier_words") == 0)})


def physical_summary(candidates: DataFrame) -> DataFrame:
    flags = {"core_physical_verbal_cells": "core", "core_physical_no_entity_shift_cells": "included_no_entity_shift", "strict_no_carrier_rows_cells": "strict_no_carrier_rows"}
    return candidates.groupBy("corpus").agg(F.count(F.lit(1)).alias("isolated_canonical_cells"), *(F.count_if(c).alias(n) for n, c in flags.items()))
