"""Pair inference traces: for every pair of a sentence that an event, a proposal, a prediction or a release holds, how far it got and why.

Tables, each by sentence_id: sentences (pred_pairs, gold_pairs: arrays of (a, b), gold null where nothing was released; parser_ok), events (event_id,
entities: those that it makes visible), proposals (candidate_id, pair_a, pair_b, assertion_status, projection_mode, source_event_id) and plans (id,
source_event_id, application_status, reason_code).

A sentence's events, proposals and plans become an array each beside its row, and each of its pairs is then a row with what it needs of them. So each table is shuffled once, by
sentence, or not at all if it lies so within `scratch.co_located`, and sorted once; nothing is grouped or joined by pair. Work grows with the rows, and within a sentence with its pairs
times its own rows. sentence_id is the key of sentences.
Ends that stand in no event, pairs of one with itself (none) and texts that are null (empty) have the results that they have in a sentence without them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dealt

# Stages, visibilities and statuses.
EMITTED, DISAGREES = "emitted", "emitted_gold_disagreement"
NOT_APPLIED, SUPPRESSED, REVIEW = "proposal_not_applied", "assertion_suppressed", "relational_review_only"
NOT_PROPOSED, NOT_BOUND, NO_EVENT, UNUSABLE = "pair_not_proposed", "argument_not_bound", "event_not_found", "parser_unusable"
VISIBLE = ("pair_candidate_exists", "same_event_no_pair", "separate_events", "one_endpoint", "neither_endpoint")
MANY_REASONS = "multiple_application_reasons"

S = "sentence_id"
_PAIRS = "array<struct<a:int,b:int>>"


def visible_entities(predicate: Column, cores: Column, owners: Column) -> Column:
    """The distinct entities that an event shows, sorted: its predicate's, its arguments' cores' and their owners' (arrays of arrays)."""
    none = F.array().cast("array<int>")
    parts = [F.coalesce(predicate, none)] + [F.coalesce(F.flatten(F.filter(x, lambda y: y.isNotNull())), none) for x in (cores, owners)]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _distinct(values: Column) -> Column:
    """Distinct texts that aren't empty, sorted."""
    return F.sort_array(F.array_distinct(F.array_remove(values, "")))


def _number(a: Column, b: Column) -> Column:
    """An unordered pair as one number, null for a pair of one with itself: numbers are found in arrays without a comparator of expressions."""
    return F.when(a != b, F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def _ends(number: Column) -> tuple[Column, Column]:
    return F.shiftright(number, 32).cast("int"), F.shiftright(F.shiftleft(number, 32), 32).cast("int")


def _numbers(pairs: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: _number(p["a"].cast("int"), p["b"].cast("int"))))


def _listed(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """A row a sentence with its rows of df in one array. They are sorted by sentence before they are grouped, so that one pass groups them (`scratch.by_sentence`)."""
    row = F.struct(*(c.alias(n) for n, c in columns.items())).alias(name)
    return df.filter(F.col(S).isNotNull()).select(S, row).sortWithinPartitions(S).groupBy(S).agg(F.collect_list(name).alias(name))


def _gathered(sentences: DataFrame, events: DataFrame, proposals: DataFrame, plans: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row a sentence with its events, proposals and plans in arrays, its entities, and its pairs as numbers."""
    own = F.sort_array(F.array_distinct(F.array_compact(F.coalesce("entities", F.array().cast("array<int>")))))
    within = F.flatten(F.transform("_own", lambda x, i: F.transform(F.slice("_own", i + 2, F.size("_own")), lambda y: _number(x, y))))
    told = F.when(_text("assertion_status") == "", "asserted").otherwise(_text("assertion_status"))
    paired = proposals.withColumn("_number", _number(F.col("pair_a").cast("int"), F.col("pair_b").cast("int"))).filter("_number IS NOT NULL")
    proposed = {"id": _text("candidate_id"), "number": F.col("_number"), "assertion": told, "mode": _text("projection_mode"), "source": _text("source_event_id"), **({"own": F.struct(*keep)} if keep else {})}
    lists = {
        "_events": _listed(events.withColumn("_own", own), "_events", event=_text("event_id"), entities=F.col("_own"), within=within),
        "_proposals": dealt(_listed(paired, "_proposals", **proposed), "proposals", S, already=True),
        "_plans": _listed(plans.filter(_text("source_event_id") != ""), "_plans", id=_text("id"), event=_text("source_event_id"), status=_text("application_status"), reason=_text("reason_code")),
    }
    rows = sentences.select(S, F.col("gold_pairs").isNotNull().alias("_released"), F.coalesce("parser_ok", F.lit(False)).alias("_parsed"), _numbers(F.col("pred_pairs")).alias("_pred"), _numbers(F.col("gold_pairs")).alias("_gold"))
    for name, listed in lists.items():
        rows = rows.join(listed, S, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return rows.withColumns({"_seen": F.flatten("_events.entities"), "_same": F.flatten("_events.within")}).withColumn("_pairs", F.array_distinct(F.concat("_pred", "_gold", "_same", "_proposals.number")))


def build_traces(sentences: DataFrame, events: DataFrame, proposals: DataFrame, plans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row a traced pair: a, b, stage, endpoint_visibility, application_status, gold_status, emitted, the references, reason_code, reason_observed and reasons.

    With keep also own: these columns of the pair's proposals, as an array of structs."""
    # Outer, as Spark otherwise asks first whether there are any, for which it makes the array once more.
    rows = _gathered(sentences, events, proposals, plans, keep).withColumn("_p", F.explode_outer("_pairs")).filter(F.col(S).isNotNull() & F.col("_p").isNotNull())
    a, b = _ends(F.col("_p"))
    rows = rows.withColumns({"a": a, "b": b, "_ends": F.array(a, b)})
    among = lambda c: F.array_contains(c, F.col("_p"))
    rows = rows.withColumns({
        "predicted": among("_pred"), "gold": among("_gold"), "same_event": among("_same"), "at_a": F.array_contains("_seen", F.col("a")), "at_b": F.array_contains("_seen", F.col("b")),
        "_mine": F.filter("_proposals", lambda q: q["number"] == F.col("_p")), "event_refs": _distinct(F.filter("_events", lambda e: F.arrays_overlap(e["entities"], F.col("_ends")))["event"]),
    }).withColumn("_asked", F.array_union("event_refs", "_mine.source"))
    # Every proposal counts towards the references, repeated ids too.
    rows = rows.withColumns({
        "proposed": F.size("_mine") > 0, "assertions": _distinct(F.col("_mine.assertion")), "modes": _distinct(F.col("_mine.mode")), "proposal_refs": F.sort_array(F.array_remove("_mine.id", "")),
        "_told": F.filter("_plans", lambda q: F.array_contains(F.col("_asked"), q["event"])),
    })
    rows = rows.withColumns({"ids": _distinct(F.col("_told.id")), "statuses": F.array_distinct("_told.status"), "reasons": _distinct(F.col("_told.reason"))})

    both, any_ = F.col("at_a") & F.col("at_b"), F.col("at_a") | F.col("at_b")
    shown = F.when(F.col("proposed"), VISIBLE[0]).when(F.col("same_event"), VISIBLE[1]).when(both, VISIBLE[2]).when(any_, VISIBLE[3]).otherwise(VISIBLE[4])
    asserted = F.array_contains("assertions", "asserted")
    relational = F.size(F.array_remove("modes", "relational")) == 0
    stage = (
        F.when(F.col("predicted") & (F.col("gold") | ~F.col("_released")), EMITTED).when(F.col("predicted"), DISAGREES)
        .when(F.col("proposed") & ~asserted, SUPPRESSED).when(F.col("proposed") & relational, REVIEW).when(F.col("proposed"), NOT_APPLIED)
        .when(F.col("same_event"), NOT_PROPOSED).when(any_, NOT_BOUND).when(F.col("_parsed"), NO_EVENT).otherwise(UNUSABLE)
    )
    rows = rows.withColumns({"stage": stage, "endpoint_visibility": shown})
    # Plans give the reason only if all of them failed.
    failed = (F.col("stage") == NOT_APPLIED) & (F.size("statuses") == 1) & (F.get("statuses", F.lit(0)) == "not_applied") & (F.size("reasons") > 0)
    rows = rows.withColumn("failed", F.coalesce(failed, F.lit(False)))
    status = F.when(F.col("failed"), "not_applied").when(F.col("stage").isin(EMITTED, DISAGREES), "applied").when(F.col("stage") == SUPPRESSED, "blocked_assertion").when(F.col("stage") == REVIEW, "review_only").when(F.col("proposed"), "not_applied_reason_unobserved").otherwise("not_generated")
    reason = F.when(F.col("failed"), F.when(F.size("reasons") == 1, F.get("reasons", F.lit(0))).otherwise(MANY_REASONS)).otherwise(F.col("stage"))
    return rows.select(
        S, "a", "b", "stage", "endpoint_visibility", status.alias("application_status"), F.when(~F.col("_released"), "unlabeled").when(F.col("gold"), "positive").otherwise("negative").alias("gold_status"), F.col("predicted").alias("emitted"),
        "proposal_refs", "event_refs", F.col("ids").alias("projection_plan_refs"), F.col("assertions").alias("assertion_statuses"), F.col("modes").alias("projection_modes"), reason.alias("reason_code"),
        (F.col("failed") | F.col("stage").isin(EMITTED, DISAGREES, SUPPRESSED, REVIEW)).alias("reason_observed"), F.when(F.col("failed"), F.col("reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"),
        *([F.col("_mine.own").alias("own")] if keep else []),
    )
