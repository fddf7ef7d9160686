"""The projection planner: from an event's arguments to its final pairs, a status and the reason.

An event is a row: event_type, asserted, negated, directed, nested, pattern_supported, group_supported, arguments (in order: slot, entities with what they are identical to, allowed,
exemplar, group, members: the entities of each slot of a coordination, null where it isn't one as a whole), and pairs found elsewhere: role_pairs (of a role nominal), compound_pairs
(within a predicate's compound) and internal_pairs (within a shared group). All is one expression of the row; nothing is shuffled. The branches, the first that holds:

not asserted, negated, a relation statement (its role pairs, or for review only), an event type without pairs, directed (pattern unsupported; diagonal of two groups of one size; each source with
each target; without target entities the pairs within the sources of a group object), nested inner events (within the compound; without group semantics), undirected (pattern unsupported; within the group; each
participant with each later one unless both are examples, and within each that isn't). Null flags are false, null arrays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types, slots, reasons, statuses and modes.
STATEMENT, PROJECTED = "RELATION_STATEMENT", ("INTERACTION", "INTERACTION_STATE")
NOT_ASSERTED, NEGATED, NO_PATTERN, NO_GROUP = "blocked_assertion", "blocked_predicate_negation", "blocked_pattern_support", "blocked_nested_without_group_semantics"
WITHIN, PROJECTION, ROLE, REVIEW, NO_PAIRS = "applied_group_internal_topology", "applied_relation_projection", "applied_relational_role_nominal", "relational_review_only", "no_projectable_pairs"

PAIR = "struct<a:int,b:int>"
ARGUMENT = "struct<slot:string,entities:array<int>,allowed:boolean,exemplar:boolean,group:boolean,members:array<array<int>>>"


def _none() -> Column:
    return F.array().cast(f"array<{PAIR}>")


def _cross(first: Column, second: Column) -> Column:
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))


def normal(pairs: Column) -> Column:
    """Distinct pairs of two, the lesser first, sorted."""
    ordered = F.transform(F.coalesce(pairs, _none()), lambda p: F.struct(F.least(p["a"], p["b"]).alias("a"), F.greatest(p["a"], p["b"]).alias("b")))
    return F.array_sort(F.array_distinct(F.filter(ordered, lambda p: p["a"] < p["b"])))


def _of(slot: str) -> Column:
    return F.filter("_args", lambda x: (x["slot"] == slot) & F.coalesce(x["allowed"], F.lit(False)))


def _entities(arguments: Column) -> Column:
    return F.flatten(F.transform(arguments, lambda x: F.coalesce(x["entities"], F.array().cast("array<int>"))))


def _diagonal() -> Column:
    """The aligned pairs of the first source and target, sources first, that are groups of one size; null without such."""
    whole = lambda x: F.coalesce(F.size(x["members"]) > 1, F.lit(False))
    sides = lambda s, t: F.filter(F.col(t), lambda y: whole(y) & (F.size(y["members"]) == F.size(s["members"])))
    met = F.flatten(F.transform(F.filter(F.col("_sources"), whole), lambda s: F.transform(sides(s, "_targets"), lambda t: F.struct(s["members"].alias("s"), t["members"].alias("t")))))
    first = F.get(met, F.lit(0))
    return F.when(F.size(met) > 0, F.flatten(F.zip_with(first["s"], first["t"], _cross)))


def _directed() -> Column:
    sources, targets = F.col("_sources"), F.col("_targets")
    inside = _cross(_entities(sources), _entities(sources))
    return F.when(F.size(_entities(targets)) > 0, F.coalesce(_diagonal(), _cross(_entities(sources), _entities(targets)))).when(F.exists(targets, lambda t: F.coalesce(t["group"], F.lit(False))), inside).otherwise(_none())


def _undirected() -> Column:
    people = F.col("_participants")
    shown = lambda x: F.coalesce(x["exemplar"], F.lit(False))
    entities = lambda x: F.coalesce(x["entities"], F.array().cast("array<int>"))
    later = lambda x, i: F.filter(F.slice(people, i + 2, F.greatest(F.size(people) - i - 1, F.lit(0))), lambda y: ~(shown(x) & shown(y)))
    across = F.flatten(F.transform(people, lambda x, i: F.flatten(F.transform(later(x, i), lambda y: _cross(entities(x), entities(y))))))
    within = F.flatten(F.transform(F.filter(people, lambda x: ~shown(x)), lambda x: _cross(entities(x), entities(x))))
    return F.concat(across, within)


def plan(events: DataFrame) -> DataFrame:
    """events with final_pairs, application_status, reason_code and projection_mode."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = events.withColumn("_args", F.coalesce("arguments", F.array().cast(f"array<{ARGUMENT}>"))).withColumns({"_sources": _of("sources"), "_targets": _of("targets"), "_participants": _of("participants")})
    rows = rows.withColumns({f"_{n}": normal(F.col(f"{n}_pairs")) for n in ("role", "compound", "internal")}).withColumns({"_directed": normal(_directed()), "_undirected": normal(_undirected())})
    some = lambda c: F.size(c) > 0
    steps: list[tuple[Column, str, str | None]] = [
        (~flag("asserted"), NOT_ASSERTED, None), (flag("negated"), NEGATED, None),
        ((F.col("event_type") == STATEMENT) & some("_role"), ROLE, "_role"), (F.col("event_type") == STATEMENT, REVIEW, None), (~F.coalesce(F.col("event_type").isin(*PROJECTED), F.lit(False)), NO_PAIRS, None),
        (flag("directed") & ~flag("pattern_supported"), NO_PATTERN, None), (flag("directed") & some("_directed"), PROJECTION, "_directed"), (flag("directed"), NO_PAIRS, None),
        (flag("nested") & some("_compound"), WITHIN, "_compound"), (flag("nested") & ~flag("group_supported"), NO_GROUP, None), (~flag("pattern_supported"), NO_PATTERN, None),
        (some("_internal"), WITHIN, "_internal"), (some("_undirected"), PROJECTION, "_undirected"),
    ]
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r, _ in steps), F.lit(NO_PAIRS))
    pairs = F.coalesce(*(F.when(c, F.col(p) if p else _none()) for c, _, p in steps), _none())
    statement = F.col("event_type") == STATEMENT
    passed = flag("asserted") & ~flag("negated")
    nested = ~flag("directed") & flag("nested") & some("_compound")
    mode = (
        F.when(passed & statement & some("_role"), "relational_role_nominal").when(statement, "relational").when(passed & ~F.coalesce(F.col("event_type").isin(*PROJECTED), F.lit(False)), "unknown")
        .when(flag("directed"), "directed").when(passed & nested, "predicate_compound_internal_pairs")
        .when(passed & flag("pattern_supported") & (~flag("nested") | flag("group_supported")) & some("_internal"), "shared_group_internal_pairs").otherwise("undirected")
    )
    out = rows.withColumns({"final_pairs": pairs, "reason_code": reason, "projection_mode": mode})
    status = F.when(F.size("final_pairs") > 0, "applied").when(F.col("reason_code") == REVIEW, "review_only").otherwise("not_applied")
    return out.withColumn("application_status", status).drop(*(c for c in out.columns if c.startswith("_")))
