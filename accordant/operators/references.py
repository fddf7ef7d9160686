"""References before events: pronouns, declared nominals and demonstrative groups inherit the entities of what they refer to.

Tables, each by sentence_id:

* nodes: i, word, lemma, pos, dep, head_i (-1 at a root), char_start, char_end, direct and entities (arrays of entity numbers: those that the
  node names, and those it stands for). A step adds to entities, kind (which reference) and, where it is one mention, head and its nodes.
* mentions: cluster, mention, evidence_type, start, end (character spans of clusters of mentions).

All steps are joins within a sentence by node number, key or cardinality. Each gives the nodes after it and the applications of its rule.
An antecedent that doesn't fit is passed over: an earlier one may fit. A null entity array counts as empty. Sentences
without any reference come through unchanged, empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import co_located, dealt, kept
from .rules import application, union

# Words, labels, rule ids and reasons.
PLURAL = ("they", "them", "their", "theirs", "themselves", "these", "those")
DETERMINERS = ("this", "that", "the", "these", "those")
DEMONSTRATIVES = ("these", "those")
CARDINALS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
SUBJECTS = ("nsubj", "nsubjpass")
NOMINAL = ("NOUN", "PROPN")
PRONOUN_RULE, IS_A_RULE = "reference.pronoun_number_agreement@1", "reference.is_a_nominal_antecedent@1"
KINDS = {"pronoun": "pronoun_coreference", "is_a": "is_a_nominal_reference", "group": "demonstrative_group_reference"}
FITS, NO_PLURAL = "pronoun_number_compatible_with_antecedent_cardinality", "singular_or_clausal_pronoun_cannot_inherit_multiple_proteins"
UNIQUE, AMBIGUOUS, CARDINALITY = "unique_prior_is_a_nominal_antecedent", "ambiguous_prior_is_a_nominal_antecedents", "reference_marker_cardinality_incompatible_with_antecedent"

S = "sentence_id"
# Characters of a stretch of text, by which spans meet the nodes within; results don't depend on it.
STRETCH = 64
_NONE = "array<int>"


def _array(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def _own() -> Column:
    return F.when(F.size(_array("direct")) > 0, _array("direct")).otherwise(_array("entities"))


def _merged(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def lemma() -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(F.col("lemma"), F.lit("")), F.col("word"), F.lit(""))))


def asof_equal(rows: DataFrame, anchors: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """rows with the value of the last anchor that stands before them (at is less) and equals them in all of by. Anchors that differ in by,
    such as in their cardinality, are passed over, however near. One window over both tables; rows have no column named like value."""
    mark = F.lit(None).cast(anchors.schema[value].dataType)
    both = rows.withColumns({value: mark, "_anchor": F.lit(1)}).unionByName(anchors.select(*by, at, value).withColumn("_anchor", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("_anchor") == 0, F.col(value)), ignorenulls=True).over(before)
    return both.withColumn(value, found).filter("_anchor = 1").drop("_anchor")


def _places() -> Column:
    """The node and, of a conjunct, the node that it hangs on."""
    return F.array_distinct(F.array_compact(F.array("i", F.when(F.col("dep") == "conj", F.col("head_i")))))


def coordinated(nodes: DataFrame) -> DataFrame:
    """Explicit coordinations: sentence_id, head, last (their last node) and entities, of a head with entities and its conjuncts with entities, where each names one of its own."""
    named = nodes.select(S, "i", "dep", "head_i", _own().alias("own")).filter(F.size("own") > 0)
    groups = named.select(S, "i", "own", F.explode(_places()).alias("head")).groupBy(S, "head").agg(
        F.max("i").alias("last"), F.count(F.lit(1)).alias("members"), _merged(F.collect_list("own")).alias("entities"), F.bool_or(F.col("i") == F.col("head")).alias("named")
    )
    return groups.filter(F.col("named") & (F.col("members") > 1) & (F.size("entities") == F.col("members"))).select(S, "head", "last", "entities")


def _within(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """spans (start, end) with the nodes of their sentence that lie within. A span meets the nodes that begin in its stretches of the text, not all of its sentence; what of it
    lies beyond the sentence's nodes has no stretch."""
    ends = nodes.groupBy(S).agg(F.min("char_start").alias("_first"), F.max("char_start").alias("_last"))
    inside = spans.join(ends, S).withColumns({"_from": F.greatest("start", "_first"), "_to": F.least("end", "_last")}).filter("_from <= _to")
    at = lambda c: F.floor(F.col(c) / STRETCH).cast("int")
    inside = inside.withColumn("_at", F.explode(F.sequence(at("_from"), at("_to")))).drop("_first", "_last", "_from", "_to")
    return inside.join(nodes.withColumn("_at", at("char_start")), [S, "_at"]).filter("char_start >= start AND char_end <= end").drop("_at")


def pronouns(nodes: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pronouns of a cluster inherit the entities of its other mentions: one by any pronoun, several by a plural one, or by `which` where they are
    an explicit coordination. Of clusters that both hold a pronoun the later one counts."""
    spans = mentions.filter("evidence_type = 'pronoun'").select(S, "cluster", "mention", "start", "end")
    slim = nodes.select(S, "i", "head_i", "pos", lemma().alias("lemma"), "char_start", "char_end", _array("entities").alias("entities"))
    within = dealt(_within(spans, slim), "mentioned", S, already=True)
    each = within.groupBy(S, "cluster", "mention").agg(F.count(F.lit(1)).alias("n"), _merged(F.collect_list("entities")).alias("entities"), F.array_sort(F.collect_list(F.struct("i", "head_i"))).alias("at"))
    named = each.filter(F.size("entities") > 0)
    antecedents = named.groupBy(S, "cluster").agg(_merged(F.collect_list("entities")).alias("entities"), F.count(F.lit(1)).alias("spans"), F.first("at").alias("at"))
    bare = each.filter(F.size("entities") == 0).select(S, "cluster", "mention", "n")
    standing = within.join(bare, [S, "cluster", "mention"]).filter("pos = 'PRON' OR (pos = 'DET' AND n = 1)").select(S, "cluster", "i", "lemma").distinct()
    groups = coordinated(nodes).select(S, "entities").distinct().withColumn("explicit", F.lit(True))
    met = standing.join(antecedents, [S, "cluster"]).join(groups, [S, "entities"], "left")
    fits = (F.size("entities") <= 1) | F.col("lemma").isin(*PLURAL) | ((F.col("lemma") == "which") & F.coalesce("explicit", F.lit(False)))
    tops = F.filter("at", lambda x: (x["i"] == x["head_i"]) | ~F.exists("at", lambda y: y["i"] == x["head_i"]))
    one = F.when((F.col("spans") == 1) & (F.size("entities") == 1) & (F.size(tops) == 1), F.struct(F.get(tops, F.lit(0))["i"].alias("head"), F.transform("at", lambda x: x["i"]).alias("nodes")))
    met = dealt(met.select(S, "cluster", "i", "lemma", "entities", fits.alias("fits"), one.alias("one")), "pronouns", S, already=True)
    said = {"cluster_id": F.col("cluster"), "pronoun_node_i": F.col("i"), "pronoun": F.col("lemma"), "antecedent_protein_indices": F.col("entities")}
    applications = met.select(S, F.lit(1).alias("step"), F.col("cluster").alias("place"), "i", application(F.lit(PRONOUN_RULE), F.lit("reference_resolution"), F.when(F.col("fits"), "applied").otherwise("blocked"), F.when(F.col("fits"), FITS).otherwise(NO_PLURAL), said).alias("application"))
    taken = met.filter("fits").groupBy(S, "i").agg(F.max_by("entities", "cluster").alias("_new"), F.max_by("one", F.when(F.col("one").isNotNull(), F.col("cluster"))).alias("_one"))
    return _inherited(nodes, taken, KINDS["pronoun"]), applications


def _inherited(nodes: DataFrame, taken: DataFrame, kind: str) -> DataFrame:
    """nodes whose entities are those of taken (sentence_id, i, _new and maybe _one), where they have none yet."""
    taken = taken if "_one" in taken.columns else taken.withColumn("_one", F.lit(None).cast("struct<head:int,nodes:array<int>>"))
    old = {"kind": "string", "reference_head": "int", "reference_nodes": _NONE}
    nodes = nodes.withColumns({n: F.lit(None).cast(t) for n, t in old.items() if n not in nodes.columns})
    both = nodes.join(taken, [S, "i"], "left")
    new = F.col("_new").isNotNull() & (F.size(_array("entities")) == 0)
    values = {"entities": F.col("_new"), "kind": F.lit(kind), "reference_head": F.col("_one.head"), "reference_nodes": F.col("_one.nodes")}
    return both.withColumns({n: F.when(new, v).otherwise(F.col(n)) for n, v in values.items()}).drop("_new", "_one")


def coordination_entities(nodes: DataFrame) -> DataFrame:
    """sentence_id, i, entities and holders of every node whose coordination (itself, its conjuncts, and as a conjunct its head and that one's) names any."""
    held = nodes.select(S, F.col("i").alias("holder"), _own().alias("own"), F.explode(_places()).alias("at")).filter(F.size("own") > 0)
    asking = nodes.select(S, "i", F.explode(_places()).alias("at"))
    return asking.join(held, [S, "at"]).groupBy(S, "i").agg(_merged(F.collect_list("own")).alias("entities"), F.array_sort(F.collect_set("holder")).alias("holders"))


def declarations(nodes: DataFrame, entity_nominals: list[str], owner_heads: list[str]) -> DataFrame:
    """What sentences declare nominals to be: sentence_id, key, nominal_i, source, entities and holders."""
    named = dealt(coordination_entities(nodes), "coordinations", S, already=True)
    slim = nodes.select(S, "i", "dep", "head_i", "pos", lemma().alias("key"), F.size(_array("entities")).alias("n"))
    nominal = F.col("pos").isin(*NOMINAL) & (F.col("key") != "")
    child = lambda which: slim.filter(which).select(S, F.col("head_i").alias("i"))
    heads = slim.filter(nominal & (F.col("n") == 0)).join(child("dep = 'cop'"), [S, "i"], "left_semi")
    subjects = slim.filter(F.col("dep").isin(*SUBJECTS)).select(S, F.col("i").alias("subject"), F.col("head_i").alias("i"))
    copula = heads.join(subjects, [S, "i"]).join(named.withColumnRenamed("i", "subject"), [S, "subject"]).select(S, "key", F.col("i").alias("nominal_i"), F.lit("copula_is_a").alias("source"), "entities", "holders")
    two = slim.filter("dep = 'appos' AND head_i >= 0").select(S, F.col("i").alias("i2"), F.col("head_i").alias("i1"), F.col("key").alias("key2"), nominal.alias("nominal2"))
    two = two.join(slim.select(S, F.col("i").alias("i1"), F.col("key").alias("key1"), nominal.alias("nominal1")), [S, "i1"])
    for k in "12":
        two = two.join(named.select(S, F.col("i").alias(f"i{k}"), F.col("entities").alias(f"entities{k}"), F.col("holders").alias(f"holders{k}")), [S, f"i{k}"], "left")
    second = two.filter("entities1 IS NOT NULL AND entities2 IS NULL AND nominal2").select(S, F.col("key2").alias("key"), F.col("i2").alias("nominal_i"), F.lit("appositive_is_a").alias("source"), F.col("entities1").alias("entities"), F.col("holders1").alias("holders"))
    first = two.filter("entities2 IS NOT NULL AND entities1 IS NULL AND nominal1").select(S, F.col("key1").alias("key"), F.col("i1").alias("nominal_i"), F.lit("appositive_is_a").alias("source"), F.col("entities2").alias("entities"), F.col("holders2").alias("holders"))
    marked = slim.filter((F.col("dep") == "det") & F.col("key").isin(*DETERMINERS)).select(S, F.col("head_i").alias("i2"))
    role = F.regexp_replace("key2", "s$", "").isin(*entity_nominals)
    open_ = two.filter("entities1 IS NULL AND entities2 IS NULL").filter(role & F.col("key1").isin(*owner_heads)).join(marked, [S, "i2"], "left_semi")
    of = slim.filter("dep = 'case' AND key = 'of'").select(S, F.col("head_i").alias("i"))
    owners = slim.filter(F.col("dep").startswith("nmod")).join(of, [S, "i"], "left_semi").select(S, "i", F.col("head_i").alias("i1")).join(named, [S, "i"])
    owners = owners.groupBy(S, "i1").agg(_merged(F.collect_list("entities")).alias("entities"), _merged(F.collect_list("holders")).alias("holders"))
    owned = open_.join(owners, [S, "i1"]).select(S, F.col("key2").alias("key"), F.col("i2").alias("nominal_i"), F.lit("transparent_appositive_owner_is_a").alias("source"), "entities", "holders")
    return union([copula, second, first, owned])


def is_a(nodes: DataFrame, entity_nominals: list[str], owner_heads: list[str]) -> tuple[DataFrame, DataFrame]:
    """A definite nominal without entities of its own inherits those of the nominal that an earlier part of its sentence declares under the same
    lemma: if all earlier declarations of it name the same entities, and its form allows as many."""
    slim = nodes.select(S, "i", "word", "lemma", "dep", "head_i", "pos", lemma().alias("key"), F.size(_array("entities")).alias("n"), F.size(_own()).alias("own"))
    children = slim.select(S, F.col("head_i").alias("i"), F.col("i").alias("child"), F.col("dep").alias("d"), F.col("key").alias("k"), F.col("own").alias("o"))
    marks = children.filter(F.col("d") == "det").groupBy(S, "i").agg(F.bool_or(F.col("k").isin(*DETERMINERS)).alias("definite"), F.bool_or(F.col("k").isin(*DEMONSTRATIVES)).alias("plural"))
    inner = children.filter(~F.col("d").isin("det", "case", "punct", "cc", "mark"))
    deep = inner.select(S, "i", "child").join(children.filter(~F.col("d").isin("case", "punct", "cc", "mark") & (F.col("o") > 0)).select(S, F.col("i").alias("child")), [S, "child"], "left_semi")
    beside = slim.filter("dep = 'conj'").select(S, "i", F.col("head_i").alias("above")).join(slim.filter("own > 0").select(S, F.col("i").alias("above")), [S, "above"], "left_semi")
    asking = slim.filter(F.col("pos").isin(*NOMINAL) & (F.col("key") != "") & (F.col("n") == 0)).join(marks.filter("definite"), [S, "i"])
    for anchored in (inner.filter("o > 0"), deep, beside):
        asking = asking.join(anchored.select(S, "i"), [S, "i"], "left_anti")
    told = dealt(declarations(nodes, entity_nominals, owner_heads), "declarations", S, already=True)
    text, bare = F.lower(F.trim(F.coalesce("word", F.lit("")))), F.lower(F.trim(F.coalesce("lemma", F.lit(""))))
    several = F.coalesce("plural", F.lit(False)) | ((bare != "") & text.endswith("s") & (text != bare))
    met = asking.withColumn("several", several).select(S, "i", "key", "several").join(told, [S, "key"]).filter("nominal_i < i")
    each = met.groupBy(S, "i", "key").agg(
        F.collect_set("entities").alias("sets"), F.bool_and(F.col("several") | (F.size("entities") <= 1)).alias("allowed"), F.array_sort(F.collect_list(F.struct("nominal_i", "source", "entities", "holders"))).alias("told")
    )
    each = dealt(each.withColumn("fits", (F.size("sets") == 1) & F.col("allowed")), "nominals", S, already=True)
    reason = F.when(F.col("fits"), UNIQUE).when(~F.col("allowed"), CARDINALITY).otherwise(AMBIGUOUS)
    said = {"reference_node_i": F.col("i"), "reference_lemma": F.col("key"), "candidate_declarations": F.col("told")}
    applications = each.select(S, F.lit(2).alias("step"), F.lit(0).alias("place"), "i", application(F.lit(IS_A_RULE), F.lit("reference_resolution"), F.when(F.col("fits"), "applied").otherwise("blocked"), reason, said).alias("application"))
    return _inherited(nodes, each.filter("fits").select(S, "i", F.col("sets")[0].alias("_new")), KINDS["is_a"]), applications


def demonstratives(nodes: DataFrame) -> DataFrame:
    """`these two X`: a nominal with a demonstrative and one number inherits the latest explicit coordination before it that has as many entities."""
    slim = nodes.select(S, "i", "dep", "head_i", "pos", lemma().alias("key"), F.size(_array("entities")).alias("n"))
    words = F.create_map(*(x for k, v in CARDINALS.items() for x in (F.lit(k), F.lit(v))))
    value = F.coalesce(F.when(F.col("key").rlike("^[0-9]{1,9}$"), F.col("key").try_cast("int")), F.element_at(words, F.col("key")))
    marks = slim.withColumn("shown", (F.col("dep") == "det") & F.col("key").isin(*DEMONSTRATIVES)).withColumn("number", F.when((F.col("dep") == "nummod") | (F.col("pos") == "NUM"), value))
    marks = marks.groupBy(S, F.col("head_i").alias("i")).agg(F.bool_or("shown").alias("shown"), F.collect_list("number").alias("numbers")).filter((F.size("numbers") == 1) & F.col("shown"))
    asking = slim.filter(F.col("pos").isin(*NOMINAL) & (F.col("n") == 0)).join(marks, [S, "i"]).select(S, "i", F.col("numbers")[0].alias("size"))
    groups = coordinated(nodes).groupBy(S, F.col("last").alias("i"), F.size("entities").alias("size")).agg(F.min_by("entities", "head").alias("_new"))
    found = asof_equal(asking, groups, [S, "size"], "i", "_new").filter("_new IS NOT NULL")
    return _inherited(nodes, found.select(S, "i", "_new"), KINDS["group"])


def resolve(nodes: DataFrame, mentions: DataFrame, entity_nominals: list[str], owner_heads: list[str], is_a_enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """All three steps. nodes after them, and the applications (sentence_id, step, place, i, application). nodes and mentions are read many times, so
    they should be stored, and dealt by sentence: then no step shuffles. What each step decides and its nodes are written once for the next."""
    with co_located(nodes.sparkSession):
        nodes, said = pronouns(nodes, mentions)
        parts = [said]
        if is_a_enabled:
            nodes, said = is_a(dealt(nodes, "nodes", S, already=True), entity_nominals, owner_heads)
            parts.append(said)
        return dealt(demonstratives(dealt(nodes, "nodes", S, already=True)), "resolved", S, already=True), kept(union(parts), "applications")
