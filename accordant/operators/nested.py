"""Nested events: nominal events within others, what controls them, and events that refer to events.

`inner_events` builds the event of a nominal (`the interaction of A with B`) from the entities of its phrase, which are reached level by level over the node
table, DEPTH levels at most. `claimed` gives each nominal to the first event that refers to it; `unconsumed` takes it out of the others by an anti-join.
`control` fills the missing side of an inner event with the sources of the event around it. `compose` resolves events that refer to events from the
leaves up over a directed graph: a level is a join of the open references with the events resolved last. Events on a cycle, or above one, are
never resolved; they come out marked. A reference to an event that isn't there counts as none. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from .references import lemma
from .rules import union

# Dependencies, markers and rule ids.
FIRST, WITHIN = ("compound", "nmod", "conj"), ("compound", "nmod", "conj", "appos", "amod")
COMPLEMENTS, SUBJECT_PREPOSITIONS, ADJUNCT_PREPOSITIONS = ("with", "to"), ("in",), ("by", "through", "via")
CONTROLLERS = ("engage", "form", "implicate", "involve", "participate")
SUBJECT_RULE, ADJUNCT_RULE = "extraction.dep_nested_subject_control@1", "extraction.dep_nested_adjunct_control@1"
DEPTH = 3

S = "sentence_id"


def _plain(dep: str = "dep") -> Column:
    """A dependency without its subtype."""
    return F.substring_index(dep, ":", 1)


def prepositions(nodes: DataFrame) -> DataFrame:
    """sentence_id, i and prep: the first case marker of a node, or else of the node that its conjunction starts with."""
    marks = nodes.filter("dep = 'case'").select(S, F.col("head_i").alias("i"), F.struct(F.col("i").alias("k"), lemma().alias("w")).alias("m")).groupBy(S, "i").agg(F.min("m.k").alias("k"), F.min_by("m.w", "m.k").alias("own"))
    top = nodes.select(S, "i", F.when((F.col("dep") == "conj") & (F.col("head_i") >= 0), F.col("head_i")).otherwise(F.col("i")).alias("root"))
    for _ in range(3):  # pointers are followed twice as far each time: chains of eight
        top = top.join(top.select(S, F.col("i").alias("root"), F.col("root").alias("next")), [S, "root"], "left").select(S, "i", F.coalesce("next", "root").alias("root"))
    both = top.join(marks.select(S, "i", "own"), [S, "i"], "left").join(marks.select(S, F.col("i").alias("root"), F.col("own").alias("far")), [S, "root"], "left")
    return both.select(S, "i", F.coalesce("own", "far", F.lit("")).alias("prep"))


def inner_events(nodes: DataFrame, nominals: list[str]) -> tuple[DataFrame, DataFrame]:
    """The events (sentence_id, head, directed) of nominals of the list whose phrase names two entities or more, and their arguments (head, i, slot, prep, ordinal).

    With a `by` phrase and others, `by` gives the sources. With two prepositions the first gives them, with one and compounds of the head the compounds do; else all are participants."""
    slim = nodes.select(S, "i", "head_i", _plain().alias("dep"), "pos", F.coalesce("entities", F.array().cast("array<int>")).alias("entities"), lemma().alias("lemma"))
    heads = slim.filter(F.col("lemma").isin(*nominals) & (F.col("pos") == "NOUN")).select(S, F.col("i").alias("head"))
    below = slim.select(S, "i", F.col("head_i").alias("above"), "dep", "entities")
    level = heads.withColumns({"above": F.col("head"), "path": F.array().cast("array<int>")}).join(below.filter(F.col("dep").isin(*FIRST)), [S, "above"])
    levels = []
    for depth in range(DEPTH):
        level = level.select(S, "head", F.concat("path", F.array("i")).alias("path"), "i", "dep", "entities")
        levels.append(level.withColumn("near", F.lit(depth == 0)))
        if depth + 1 < DEPTH:
            level = level.select(S, "head", "path", F.col("i").alias("above")).join(below.filter(F.col("dep").isin(*WITHIN)), [S, "above"])
    found = union(levels).filter((F.size("entities") > 0) & (F.col("i") != F.col("head")))
    found = found.groupBy(S, "head", "i").agg(F.min("path").alias("path"), F.bool_or(F.col("near") & (F.col("dep") == "compound")).alias("anchor"), F.first("entities").alias("entities"))
    rows = kept(found.join(prepositions(nodes), [S, "i"]), "phrases")
    each = rows.groupBy(S, "head").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("names"), F.count_if(F.col("prep") == "by").alias("by"), F.count_if(F.col("prep") != "by").alias("rest"), F.size(F.collect_set(F.when(F.col("prep") != "", F.col("prep")))).alias("preps"),
        F.min_by("prep", F.when(F.col("prep") != "", F.col("path"))).alias("first"), F.count_if(F.col("prep") == "").alias("bare"), F.bool_and((F.col("prep") != "") | F.col("anchor")).alias("anchored"),
    ).filter("names > 1")
    compound = (F.col("preps") == 1) & (F.col("bare") > 0) & F.col("anchored")
    side = F.when((F.col("by") > 0) & (F.col("rest") > 0), "by").when(compound, "").when(F.col("preps") > 1, F.col("first"))
    each = each.withColumn("side", side)
    events = each.select(S, "head", F.col("side").isNotNull().alias("directed"))
    slot = F.when(F.col("side").isNull(), "participants").when(F.col("prep") == F.col("side"), "sources").otherwise("targets")
    at = Window.partitionBy(S, "head").orderBy("path")
    args = rows.join(each.select(S, "head", "side"), [S, "head"]).withColumn("ordinal", F.row_number().over(at) - 1).select(S, "head", "i", slot.alias("slot"), "prep", "entities", "ordinal")
    return events, args


def claimed(references: DataFrame) -> DataFrame:
    """Of references (sentence_id, outer, head, role) the first to each head, by outer."""
    return references.groupBy(S, "head").agg(F.min_by(F.struct("outer", "role"), F.struct("outer", "role")).alias("_r")).select(S, "head", "_r.outer", "_r.role")


def unconsumed(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Events (sentence_id, head) whose head no other event has taken in."""
    return events.join(claims.filter("outer <> head").select(S, "head"), [S, "head"], "left_anti")


def control(events: DataFrame, arguments: DataFrame, claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undirected inner events whose participants all are `with` or `to` complements become directed where the event around them controls them: a verb of
    CONTROLLERS that has them as object or after `in`, or any after `by`, `through` or `via`. Its sources (sentence_id, outer, i, entities) become theirs, their participants the targets.

    claims: sentence_id, head, outer, role (a dependency, with its preposition after a colon) and lemma, the outer event's. Events get rule_id, null where nothing controls them."""
    kinds = arguments.groupBy(S, "head").agg(F.bool_and((F.col("slot") == "participants") & F.col("prep").isin(*COMPLEMENTS)).alias("fits"))
    prep = F.when(F.col("role").contains(":"), F.substring_index("role", ":", -1)).otherwise("")
    subject = F.col("lemma").isin(*CONTROLLERS) & ((_plain("role") == "obj") | prep.isin(*SUBJECT_PREPOSITIONS))
    rule = F.when(subject, SUBJECT_RULE).when(prep.isin(*ADJUNCT_PREPOSITIONS), ADJUNCT_RULE)
    able = claims.join(sources.select(S, "outer").distinct(), [S, "outer"], "left_semi").withColumn("rule", rule).filter("rule IS NOT NULL").select(S, "head", "outer", "rule")
    taken = events.filter("NOT directed").join(kinds.filter("fits"), [S, "head"]).join(able, [S, "head"]).select(S, "head", "outer", "rule")
    out = events.join(taken.select(S, "head", F.col("rule").alias("rule_id")), [S, "head"], "left").withColumn("directed", F.col("directed") | F.col("rule_id").isNotNull())
    moved = arguments.join(taken.select(S, "head", F.lit(True).alias("_moved")), [S, "head"], "left").withColumn("slot", F.when(F.col("_moved"), "targets").otherwise(F.col("slot"))).drop("_moved")
    filled = taken.join(sources, [S, "outer"])
    order = F.row_number().over(Window.partitionBy(S, "head").orderBy("i")) - 1
    filled = filled.select(S, "head", "i", F.lit("sources").alias("slot"), F.lit("").alias("prep"), "entities", order.alias("ordinal"))
    return out, moved.unionByName(filled)


def compose(events: DataFrame, references: DataFrame, by: str = S) -> DataFrame:
    """events (by, event, entities) with level, all_entities and cyclic, over references (by, outer, inner).

    Level 0 refers to none. Each later level has those all of whose references were resolved, and shows its own entities and theirs. What is left when a level
    comes out empty refers to a cycle: level and all_entities are null."""
    own = kept(events.select(by, "event", F.coalesce("entities", F.array().cast("array<int>")).alias("entities")), "events")
    edges = references.select(by, "outer", "inner").distinct().join(own.select(by, F.col("event").alias("outer")), [by, "outer"], "left_semi").join(own.select(by, F.col("event").alias("inner")), [by, "inner"], "left_semi")
    open_ = kept(edges.withColumns({"shown": F.lit(None).cast("array<int>")}), "references")
    done = [kept(own.join(open_.select(by, F.col("outer").alias("event")), [by, "event"], "left_anti").select(by, "event", F.col("entities").alias("all_entities"), F.lit(0).alias("level")), "level")]
    while not open_.isEmpty():
        last = done[-1].select(by, F.col("event").alias("inner"), F.col("all_entities").alias("_new"))
        open_ = kept(open_.join(last, [by, "inner"], "left").select(by, "outer", "inner", F.coalesce("shown", "_new").alias("shown")), "references")
        ready = open_.groupBy(by, "outer").agg(F.bool_and(F.col("shown").isNotNull()).alias("ready"), F.flatten(F.collect_list("shown")).alias("shown")).filter("ready")
        level = ready.join(own.withColumnRenamed("event", "outer"), [by, "outer"]).select(by, F.col("outer").alias("event"), F.array_sort(F.array_distinct(F.concat("entities", "shown"))).alias("all_entities"), F.lit(len(done)).alias("level"))
        done.append(kept(level, "level"))
        if done[-1].isEmpty():
            break
        open_ = open_.join(done[-1].select(by, F.col("event").alias("outer")), [by, "outer"], "left_anti")
    return own.join(union(done), [by, "event"], "left").withColumn("cyclic", F.col("level").isNull())
