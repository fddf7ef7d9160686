"""Rows of extracted events: their span, pattern identity and the row that an event store keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.text import span_of
from .ledgers import first_text


def lemma(span: Column, nominal: Column | None = None) -> Column:
    """The first lemma of a span (struct of text and lemmas), or its text, lower-cased; with nominal, a map, a noun's verb."""
    own = F.lower(F.when(F.size(span["lemmas"]) > 0, span["lemmas"][0]).otherwise(span["text"]))
    return own if nominal is None else F.coalesce(F.try_element_at(nominal, own), own)


def pattern_identity(event: Column, nominal: Column) -> Column:
    """evidence class, shape, concept, case and construction of an event (struct: event_type, relation_subtype, construction, is_directed,
    predicate: struct of text, lemmas and pos, case_markers: array of spans of its targets in order). Null for an event without predicate
    that states no relation."""
    said = event["event_type"] == "RELATION_STATEMENT"
    predicate = event["predicate"]
    concept = F.when(predicate.isNotNull(), lemma(predicate, nominal)).when(said, F.lower(first_text(F.coalesce(event["relation_subtype"], F.lit("")), F.lit("relational"))))
    built = F.when(F.coalesce(event["construction"], F.lit("")) != "", event["construction"]).when(said, F.when(predicate["pos"].isin("NOUN", "PROPN"), "nominalized").otherwise("verbal"))
    case = F.when(~said & (F.size(event["case_markers"]) > 0), lemma(event["case_markers"][0])).otherwise("")
    shape = F.when(said, "RELATIONAL").when(F.coalesce(event["is_directed"], F.lit(False)), "AB").otherwise("AA")
    parts = F.struct(F.when(said, "relational").otherwise("structural").alias("evidence_class"), shape.alias("shape"), concept.alias("concept"), case.alias("case"), F.coalesce(built, F.lit("")).alias("construction"))
    return F.when(said | predicate.isNotNull(), parts).otherwise(F.lit(None).cast("struct<evidence_class:string,shape:string,concept:string,case:string,construction:string>"))


def pattern_key(identity: Column) -> Column:
    return F.when(identity.isNotNull(), K.canonical_key(*(identity[x] for x in ("evidence_class", "shape", "concept", "case", "construction"))))


def semantic_pattern_key(identity: Column) -> Column:
    return F.when(identity.isNotNull(), K.semantic_key(*(identity[x] for x in ("evidence_class", "shape", "concept", "case", "construction"))))


def event_rows(events: DataFrame, nominal: Column) -> DataFrame:
    """The rows of a store's event table, of events with sentence_id, sentence, token_offsets, tokens (all token numbers of the event), arguments (a map
    of role to array of structs) and the struct event: spans, keys, and arguments as JSON. Older events carry their keys in chain (a map)."""
    identity = pattern_identity(F.col("event"), nominal)
    chain = lambda n: F.try_element_at("chain", F.lit(n)) if "chain" in events.columns else F.lit(None).cast("string")
    given = lambda c, n: F.coalesce(F.nullif(c, F.lit("")), chain(n))
    many = F.size("tokens") > 0
    return events.select(
        "sentence_id", F.col("event.event_type").alias("event_type"), F.nullif(span_of(F.col("sentence"), F.col("tokens"), F.col("token_offsets")), F.lit("")).alias("span"),
        F.when(many, F.array_min("tokens")).alias("span_min"), F.when(many, F.array_max("tokens")).alias("span_max"), F.col("event.predicate.text").alias("predicate_text"), F.when(F.col("event.predicate").isNotNull(), lemma(F.col("event.predicate"))).alias("predicate_lemma"),
        given(pattern_key(identity), "pattern_key").alias("pattern_key"), given(semantic_pattern_key(identity), "semantic_pattern_key").alias("semantic_pattern_key"), given(F.col("event.construction"), "construction").alias("construction"),
        F.coalesce(chain("is_inferred").cast("int"), F.lit(0)).alias("is_inferred"), F.when(F.size("arguments") > 0, F.to_json("arguments")).alias("arguments_json"),
    )


#: A group of an argument that says how its members stand to each other.
GROUP = "array<struct<group:struct<role_protein_indices:array<int>,all_protein_indices:array<int>,member_internal_pairs:array<array<int>>,members:array<string>>>>"


def has_useful_group(arguments_json: Column) -> Column:
    """Whether any argument has a group with members, indices or pairs; empty groups say nothing."""
    frames = F.flatten(F.map_values(F.from_json(arguments_json, f"map<string,{GROUP}>")))
    some = lambda x, n=0: F.coalesce(F.size(x), F.lit(0)) > n
    useful = lambda f: some(f["group"]["role_protein_indices"]) | some(f["group"]["all_protein_indices"]) | some(f["group"]["member_internal_pairs"]) | some(f["group"]["members"], 1)
    return F.coalesce(F.exists(frames, useful), F.lit(False))


def semantic_evidence(events: DataFrame, sentences: DataFrame, limit: int = 250) -> DataFrame:
    """The first events with a useful group, beside their sentence: filtered before the limit, which is the page's length."""
    rows = events.filter(F.col("arguments_json").contains('"group"') & has_useful_group(F.col("arguments_json")))
    return rows.join(sentences, "sentence_id").orderBy("sentence_id", "event_id").limit(limit)


def last_split_wins(splits: list[DataFrame], key: str) -> DataFrame:
    """Splits as one table; a later split's row takes the place of an earlier one's of its key."""
    tagged = [df.withColumn("_split", F.lit(i)) for i, df in enumerate(splits)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    columns = [c for c in splits[0].columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_split").alias("r")).select(key, "r.*")
