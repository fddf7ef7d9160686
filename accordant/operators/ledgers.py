"""The statistics ledgers of an event store: a row a pair, a pattern firing, a lexical attribution, a carrier, an event, and the totals.

The store's tables are DataFrames: sentences (sentence_id, pred_pairs, gold_pairs: arrays of (a, b), gold null where nothing was
released; traces: array of structs, may be empty), candidates (a row a proposed relation), attributions and events. A column that a
table lacks counts as empty, so stores of older layouts can be read. Pairs are unordered; a pair of one with itself is no pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from .traces import build_traces

PAIR = "struct<a:int,b:int>"
_TRACE = (
    f"array<struct<pair:{PAIR},stage:string,endpoint_visibility:string,application_status:string,reason_code:string,proposal_refs:array<string>,"
    "event_refs:array<string>,projection_plan_refs:array<string>,assertion_statuses:array<string>,projection_modes:array<string>>>"
)


def text(df: DataFrame, name: str) -> Column:
    """A column as text, empty where it is null or where the table has none."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def number(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)


def first_text(*options: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.when(o != "", o) for o in options), F.lit(""))


def pairs(values: Column) -> Column:
    """Distinct unordered pairs of an array of (a, b), sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda p: K.pair(p["a"], p["b"])), lambda p: p.isNotNull())))


def pairs_of_json(value: Column) -> Column:
    """The pairs of a JSON list of two-number lists; null for null and for what doesn't parse."""
    return F.transform(F.from_json(value, "array<array<int>>"), lambda p: F.struct(p[0].alias("a"), p[1].alias("b")))


def gold_label(pair: Column, gold: Column) -> Column:
    return F.when(gold.isNull(), "unlabeled").when(F.array_contains(gold, pair), "positive").otherwise("negative")


def _payload(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit("")) if "payload" in df.columns else F.lit("")


def _joined(name: str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.collect_set(name), lambda x: x != "")), "|")


_PROPOSED = ("pattern_key", "predicate_lemma", "realization_channel", "assertion_status", "projection_mode")


def _proposed(candidates: DataFrame) -> dict[str, Column]:
    """What a ledger says of proposals: their patterns, triggers, channels, statuses and modes."""
    key = first_text(text(candidates, "canonical_pattern_key"), _payload(candidates, "pattern_key"))
    return {n: key if n == "pattern_key" else text(candidates, n) for n in _PROPOSED}


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """A row a sentence with its proposals and their pairs in one array."""
    pair = K.pair(F.col("pair_a"), F.col("pair_b")).cast(PAIR)
    rows = candidates.select("sentence_id", F.struct(pair.alias("pair"), *(c.alias(n) for n, c in _proposed(candidates).items())).alias("_proposed")).filter("_proposed.pair IS NOT NULL")
    # Sorted by sentence, so that one pass groups them (`scratch.by_sentence`).
    return rows.repartition("sentence_id").sortWithinPartitions("sentence_id").groupBy("sentence_id").agg(F.collect_list("_proposed").alias("_proposed"))


def _rows(both: DataFrame, corpus: str) -> DataFrame:
    """The ledger's rows of sentence_id, pair, gold_label, predicted_label, a trace t and the pair's own proposals."""

    def merged(*lists: str) -> Column:
        parts = [F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists]
        return K.joined_unique(F.concat(*parts) if len(parts) > 1 else parts[0])

    plain = lambda n: F.coalesce(F.col(f"t.{n}"), F.lit(""))
    return both.select(
        F.lit(corpus).alias("corpus"), "sentence_id", F.col("pair.a").alias("pair_a"), F.col("pair.b").alias("pair_b"), "gold_label", "predicted_label", *(plain(n).alias(n) for n in ("stage", "endpoint_visibility", "application_status", "reason_code")),
        F.size("own").cast("long").alias("proposal_count"), merged("own.pattern_key").alias("pattern_keys"), merged("own.predicate_lemma").alias("trigger_lemmas"), merged("own.realization_channel").alias("realization_channels"),
        merged("t.assertion_statuses", "own.assertion_status").alias("assertion_statuses"), merged("t.projection_modes", "own.projection_mode").alias("projection_modes"),
        *(merged(f"t.{n}").alias(n) for n in ("proposal_refs", "event_refs", "projection_plan_refs")),
    )


def traced_ledger(sentences: DataFrame, events: DataFrame, candidates: DataFrame, plans: DataFrame, corpus: str) -> DataFrame:
    """The pair ledger of sentences whose traces are made here (`traces.build_traces`): what it says of a pair's proposals comes with its trace, as one row all the way."""
    told = candidates.select("sentence_id", "candidate_id", "pair_a", "pair_b", "source_event_id", *(c.alias(n) for n, c in _proposed(candidates).items()))
    rows = build_traces(sentences, events, told, plans, keep=_PROPOSED)
    names = ("stage", "endpoint_visibility", "application_status", "reason_code", "proposal_refs", "event_refs", "projection_plan_refs", "assertion_statuses", "projection_modes")
    both = rows.select("sentence_id", F.struct("a", "b").alias("pair"), F.col("gold_status").alias("gold_label"), F.when(F.col("emitted"), "positive").otherwise("negative").alias("predicted_label"), F.struct(*names).alias("t"), "own")
    return _rows(both, corpus)


def pair_ledger(sentences: DataFrame, candidates: DataFrame, corpus: str) -> DataFrame:
    """A row a traced pair of each sentence; of a sentence without traces a row for every pair that is predicted, proposed or released."""
    proposed = candidate_lists(candidates)
    none = F.array().cast(f"array<{PAIR}>")
    rows = sentences.select(
        "sentence_id",
        F.coalesce(pairs(F.col("pred_pairs")), none).alias("_pred"),
        pairs(F.col("gold_pairs")).alias("_gold"),
        (F.col("traces") if "traces" in sentences.columns else F.lit(None)).cast(_TRACE).alias("_traces"),
    ).join(proposed, "sentence_id", "left")
    rows = rows.withColumn("_proposed", F.coalesce("_proposed", F.array().cast(proposed.schema["_proposed"].dataType)))
    universe = F.array_distinct(F.concat("_pred", F.coalesce("_gold", none), F.col("_proposed.pair")))

    def untraced(p: Column) -> Column:
        there = F.array_contains("_pred", p)
        empty = F.array().cast("array<string>")
        return F.struct(
            p.alias("pair"), F.when(there, "emitted").otherwise("not_traced").alias("stage"), F.lit("").alias("endpoint_visibility"), F.when(there, "applied").otherwise("").alias("application_status"),
            F.lit("").alias("reason_code"), *(empty.alias(n) for n in ("proposal_refs", "event_refs", "projection_plan_refs", "assertion_statuses", "projection_modes")),
        )

    traces = F.when(F.size("_traces") > 0, F.col("_traces")).otherwise(F.transform(universe, untraced).cast(_TRACE))
    # Outer, as Spark otherwise asks first whether there are any, for which it makes the array once more.
    traced = rows.withColumn("t", F.explode_outer(traces)).withColumn("pair", K.pair(F.col("t.pair.a"), F.col("t.pair.b"))).filter("pair IS NOT NULL")
    predicted = F.when(F.array_contains("_pred", F.col("pair")), "positive").otherwise("negative")
    own = F.filter("_proposed", lambda q: q["pair"] == F.col("pair"))
    return _rows(traced.select("sentence_id", "pair", "t", gold_label(F.col("pair"), F.col("_gold")).alias("gold_label"), predicted.alias("predicted_label"), own.alias("own")), corpus)


_PLAIN = ("predicate_lemma", "case_marker", "realization_channel", "event_detail", "source_role", "target_role", "source_argument_role", "target_argument_role", "source_parser_dep", "target_parser_dep", "assertion_status", "projection_mode", "parser_source")
_FLAGS = ("compound_propagated", "owner_propagated", "descriptor_propagated", "is_nominalized")


def pattern_ledger(sentences: DataFrame, candidates: DataFrame, corpus: str) -> DataFrame:
    """A row a proposed relation with its pattern and labels; pairs and labels are null for a relation without a pair."""
    own = candidates.select(
        text(candidates, "sentence_id").alias("sentence_id"), text(candidates, "candidate_id").alias("candidate_id"), K.pair(F.col("pair_a"), F.col("pair_b")).alias("pair"),
        _payload(candidates, "application_status").alias("application_status"), _payload(candidates, "application_reason_code").alias("application_reason_code"),
        first_text(text(candidates, "decision"), _payload(candidates, "decision")).alias("decision"),
        first_text(text(candidates, "canonical_pattern_key"), _payload(candidates, "pattern_key")).alias("canonical_pattern_key"), _payload(candidates, "semantic_pattern_key").alias("semantic_pattern_key"),
        *(first_text(text(candidates, n), _payload(candidates, n)).alias(n) for n in ("shape", "construction")), *(text(candidates, n).alias(n) for n in _PLAIN), *(number(candidates, n).alias(n) for n in _FLAGS),
    )
    known = sentences.select("sentence_id", pairs(F.col("gold_pairs")).alias("_gold"), pairs(F.col("pred_pairs")).alias("_pred"))
    both = own.join(known, "sentence_id", "left")
    is_pair = F.col("pair").isNotNull()
    predicted = F.when(F.coalesce(F.array_contains("_pred", F.col("pair")), F.lit(False)), "positive").otherwise("negative")
    rest = [c for c in own.columns if c not in ("sentence_id", "candidate_id", "pair")]
    return both.select(
        F.lit(corpus).alias("corpus"), "sentence_id", "candidate_id", F.col("pair.a").alias("pair_a"), F.col("pair.b").alias("pair_b"),
        F.when(is_pair, gold_label(F.col("pair"), F.col("_gold"))).alias("gold_label"), F.when(is_pair, predicted).alias("predicted_label"), *rest,
    )


def lexical_ledger(attributions: DataFrame, corpus: str) -> DataFrame:
    evaluable, correct = number(attributions, "is_evaluable"), number(attributions, "is_correct")
    label = F.when(evaluable == 0, "unlabeled").when(correct != 0, "positive").otherwise("negative")
    names = ("sentence_id", "term", "category", "role", "pattern_key", "event_detail")
    return attributions.select(F.lit(corpus).alias("corpus"), *(text(attributions, n).alias(n) for n in names), evaluable.alias("is_evaluable"), correct.alias("gold_positive"), label.alias("gold_label"))


def carrier_ledger(lexical: DataFrame) -> DataFrame:
    """The rows of a lexical ledger that attribute a carrier word."""
    return lexical.filter("category = 'target_context'").select("corpus", "sentence_id", F.col("term").alias("carrier_word"), "pattern_key", "role", "is_evaluable", "gold_positive", "gold_label")


def event_ledger(events: DataFrame, corpus: str) -> DataFrame:
    """A row an event: its descriptions, how many pairs it gave, and the roles of its arguments. arguments_json is an object by role;
    what isn't one counts as empty."""
    names = ("event_type", "semantic_event_class", "event_detail", "realization_channel", "relation_type", "predicate_lemma", "pattern_key", "semantic_pattern_key", "yield_type", "construction", "chain_readable")
    roles = F.map_keys(F.from_json(text(events, "arguments_json"), "map<string,string>"))
    given = F.size(F.coalesce(pairs_of_json(text(events, "pred_pairs")), F.array().cast(f"array<{PAIR}>")))
    return events.select(
        F.lit(corpus).alias("corpus"), text(events, "sentence_id").alias("sentence_id"), F.col("event_id").cast("int").alias("event_id"), *(text(events, n).alias(n) for n in names),
        number(events, "is_inferred").alias("is_inferred"), given.alias("pred_pair_count"), K.joined_unique(F.coalesce(roles, F.array().cast("array<string>"))).alias("argument_roles"),
    )


def corpus_summary(corpus: str, sentences: DataFrame, ledgers: dict[str, DataFrame]) -> DataFrame:
    """The totals of a store's ledgers (by name: events, pair, pattern and lexical observations), a row a metric."""
    counted = {"sentences": sentences, **ledgers}
    if "lexical_observations" in ledgers:
        counted["carrier_trigger_observations"] = carrier_ledger(ledgers["lexical_observations"])
    rows = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(corpus).alias("corpus"), F.lit(n).alias("metric"), "value") for n, df in counted.items()]
    return reduce(DataFrame.unionByName, rows)


def candidate_patterns(sentences: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of the asserted, unambiguous relations of each pattern key: mentions, distinct (sentence, pair), those released as positive and as
    not, and their share. Descriptions are those of the key's first mention (by id); a key is a candidate if any mention is no
    relational evidence under review."""
    relational = (F.upper("shape") == "RELATIONAL") | (F.lower(F.coalesce("projection_mode", F.lit(""))) == "relational")
    review = relational & (F.lower(F.coalesce("decision", F.lit(""))) != "applied")
    asserted = F.lower(first_text(F.coalesce("assertion_status", F.lit("")), F.lit("asserted"))) == "asserted"
    plain = F.trim(F.coalesce("ambiguity_reason", F.lit(""))) == ""
    rows = candidates.filter(asserted & plain & (F.coalesce("canonical_pattern_key", F.lit("")) != ""))
    rows = rows.select("id", "sentence_id", F.col("canonical_pattern_key").alias("pattern_key"), "predicate_lemma", "case_marker", "shape", "construction", F.when(relational, "relational").otherwise("structural").alias("evidence_class"), review.alias("review"), K.pair(F.col("pair_a"), F.col("pair_b")).alias("pair"))
    first = lambda c: F.min_by(c, "id")
    meta = rows.groupBy("pattern_key").agg(
        F.coalesce(first("predicate_lemma"), F.lit("")).alias("lemma"), F.nullif(first("case_marker"), F.lit("")).alias("preposition"), first("shape").alias("shape"), first("evidence_class").alias("evidence_class"),
        first("construction").alias("construction"), F.bool_and("review").alias("_review"), F.count(F.lit(1)).alias("observations"),
    )
    once = rows.filter("pair IS NOT NULL").select("pattern_key", "sentence_id", "pair").distinct().join(sentences.select("sentence_id", pairs(F.col("gold_pairs")).alias("_gold")), "sentence_id", "left")
    label = gold_label(F.col("pair"), F.col("_gold"))
    counts = once.groupBy("pattern_key").agg(F.count(F.lit(1)).alias("sentence_pair_observations"), F.count_if(label == "positive").alias("gold_positive_hits"), F.count_if(label == "negative").alias("gold_negative_hits"))
    both = meta.join(counts, "pattern_key", "left").na.fill(0, ["sentence_pair_observations", "gold_positive_hits", "gold_negative_hits"])
    agreement = F.round(F.coalesce(F.try_divide("gold_positive_hits", F.col("gold_positive_hits") + F.col("gold_negative_hits")), F.lit(0.0)), 4)
    return both.select(
        "pattern_key", "lemma", "preposition", "shape", "evidence_class", "construction", F.when(F.col("_review"), "review_only_evidence").otherwise("candidate").alias("review_status"),
        F.when(F.col("_review"), "candidate_relation_review").otherwise("candidate_ledger").alias("source"), "observations", "sentence_pair_observations", "gold_positive_hits", "gold_negative_hits", agreement.alias("annotation_agreement"),
    )


def residual_population(patterns: DataFrame, carriers: DataFrame, cap: int = 25) -> DataFrame:
    """The rows of the residual analysis: labelled pattern firings with their carriers (words, roles; `none` without any), `na` for what is
    empty, the document, and the predicate among the `cap` most frequent, else OTHER (ties by name)."""
    rows = patterns.filter("gold_label IN ('positive', 'negative')")
    word, role = F.lower(F.trim("carrier_word")), F.lower(F.trim("role"))
    index = carriers.filter(word != "").groupBy("corpus", "sentence_id", F.col("pattern_key").alias("canonical_pattern_key")).agg(
        *(F.array_join(F.array_sort(F.collect_set(F.when(c != "", c))), "+").alias(n) for n, c in (("carrier_words", word), ("carrier_roles", role)))
    )
    joined = rows.join(index, ["corpus", "sentence_id", "canonical_pattern_key"], "left")
    kept = joined.groupBy("predicate_lemma").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "predicate_lemma").limit(cap).select("predicate_lemma", F.lit(True).alias("_kept"))
    cue = lambda c: first_text(F.coalesce(F.col(c), F.lit("")), F.lit("na"))
    out = joined.join(F.broadcast(kept), "predicate_lemma", "left")  # cap rows
    cues = ("case_marker", "shape", "construction", "realization_channel", "assertion_status", "source_role", "target_role")
    return out.select(
        "corpus", "sentence_id", K.document_id(F.col("sentence_id"), F.col("corpus")).alias("doc"), (F.col("gold_label") == "positive").cast("int").alias("y"), F.when(F.col("_kept"), cue("predicate_lemma")).otherwise("OTHER").alias("predicate_lemma"),
        *(cue(c).alias(c) for c in cues), *(F.coalesce(F.nullif(c, F.lit("")), F.lit("none")).alias(c) for c in ("carrier_words", "carrier_roles")),
    )
