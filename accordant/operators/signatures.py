"""Signatures of lexicalised paths, their display, and the tables they are summed up in.

A path row has the lemma of its highest word (apex_lemma, apex_pos), anchor_lemmas (array), a construction, edge_prep or endpoint_preps
(array), and endpoint_edges: an array of structs (protein_index, dep, prep, via_lemma). nominal is a map column of nominal to
verbal lemmas (`nominal_map` makes one), a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .cells import first_of_group
from .ledgers import first_text
from .paths import dependency, preposition

_NAME = r"protein\d+"


def nominal_map(pairs: dict[str, str]) -> Column:
    """A literal map; for a list that is no small one, join a table instead."""
    items = [F.lit(x.strip().lower()) for kv in pairs.items() for x in kv]
    return F.create_map(*items) if items else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def anchor(lemma: Column, nominal: Column) -> Column:
    """A lemma's verb (`interaction` becomes `interact`), or the lemma, lower-cased."""
    clean = F.lower(F.trim(F.coalesce(lemma, F.lit(""))))
    return F.coalesce(F.try_element_at(nominal, clean), clean)


def prepositions(single: Column, several: Column) -> Column:
    """The signature of a path's prepositions: those of the edge, which + parts, else those of its ends; `_` without any."""
    parts = F.when(F.trim(F.coalesce(single, F.lit(""))) != "", F.split(single, r"\+")).otherwise(F.coalesce(several, F.array().cast("array<string>")))
    named = F.filter(F.transform(parts, preposition), lambda p: p != "_")
    return first_text(F.array_join(named, "+"), F.lit("_"))


def _apex(nominal: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce("apex_lemma", F.lit(""))))
    return F.when((clean == "") | clean.rlike(f"^{_NAME}$"), "").otherwise(anchor(clean, nominal))


def anchors(nominal: Column) -> Column:
    """Distinct anchors, sorted; without any the apex, so that paths without anchors don't fall together."""
    own = F.array_sort(F.array_distinct(F.transform(F.coalesce("anchor_lemmas", F.array().cast("array<string>")), lambda a: anchor(a, nominal))))
    apex = _apex(nominal)
    return F.when(F.size(own) > 0, own).when(apex != "", F.array(apex)).otherwise(F.array().cast("array<string>"))


def _construction() -> Column:
    return first_text(F.trim(F.coalesce("construction", F.lit(""))), F.lit("bare_path"))


def abstracted(nominal: Column, context: bool = False) -> Column:
    """lex_abs|construction|anchors|prepositions, with the kinds of context on both sides if asked."""
    parts = [F.lit("lex_abs"), _construction(), first_text(F.array_join(anchors(nominal), ","), F.lit("_")), prepositions(F.col("edge_prep"), F.col("endpoint_preps"))]
    if context:
        parts += [first_text(F.trim(F.coalesce(c, F.lit(""))), F.lit("none")) for c in ("left_context_kind", "right_context_kind")]
    return F.concat_ws("|", *parts)


def edge_role(edge: Column, pos: Column) -> Column:
    """The argument that an edge's dependency and preposition stand for."""
    dep, prep = dependency(edge["dep"]), preposition(edge["prep"])
    return (
        F.when((prep == "by") | (dep == "agent"), "ARG0")
        .when(dep == "nsubj", F.when(F.upper(F.trim(F.coalesce(pos, F.lit("")))) == "VERB", "ARG0").otherwise("ARG?"))
        .when(dep.isin("nsubjpass", "dobj"), "ARG1")
        .when((dep == "nmod") & prep.isin("of", "to", "with", "between/among", "on"), "ARG1")
        .when(dep == "nmod", F.when(prep == "_", "NMOD").otherwise(F.concat(F.lit("NMOD:"), prep)))
        .when(dep.isin("compound", "amod"), "MOD")
        .otherwise(F.upper(dep))
    )


def semantic(nominal: Column, coarse: bool = False, family: bool = False) -> Column:
    """lex_sem|predicate|roles, so that active, passive and nominal forms meet; with the family of construction if asked."""
    own, apex = anchors(nominal), _apex(nominal)
    listed = F.array_join(own, ",")
    nested = (F.trim(F.coalesce("construction", F.lit(""))) == "nested_dobj") & (listed != "") & (apex != "") & ~F.array_contains(own, apex)
    predicate = F.when(nested, F.concat(apex, F.lit(">"), listed)).otherwise(first_text(listed, apex, F.lit("_")))
    roles = F.array_sort(F.transform(F.coalesce("endpoint_edges", F.array().cast("array<struct<protein_index:int,dep:string,prep:string,via_lemma:string>>")), lambda e: edge_role(e, F.col("apex_pos"))))
    only = lambda *some: F.size(F.array_except(roles, F.array(*map(F.lit, some)))) == 0
    has = lambda *some: F.arrays_overlap(roles, F.array(*map(F.lit, some)))
    argument = has("ARG0", "ARG1", "ARG?")
    plain = F.array_join(roles, "+")
    rough = F.when(only("ARG0", "ARG1"), "ARG_PAIR").when(argument & has("MOD"), "ARG_MOD").when(argument & has("CONJ"), "ARG_CONJ").when(only("CONJ", "APPOS"), "COREF_COORD").otherwise(plain)
    role = F.when(F.size(roles) > 0, rough if coarse else plain).otherwise(prepositions(F.col("edge_prep"), F.col("endpoint_preps")))
    kind = F.when(_construction().isin("verbal_path", "nested_dobj"), "event_path").when(_construction().isin("nominal_prep_path", "nominal_compound"), "nominal_path").otherwise(_construction())
    return F.concat_ws("|", F.lit("lex_sem"), predicate, *([kind] if family else []), role)


def by_abstracted(rows: DataFrame, signature: str, order: str) -> DataFrame:
    """Rows of each signature: all, the distinct (sentence, pair), of these the released, the not released and the unlabelled by the first
    row's status, and the exact signatures."""
    pair = K.pair(F.col("pair_a"), F.col("pair_b"))
    named = rows.withColumn("_pair", pair)
    every = named.groupBy(signature).agg(F.count(F.lit(1)).alias("observations"), F.array_join(F.array_sort(F.collect_set(F.coalesce("pattern_signature", F.lit("")))), ";").alias("exact_signatures"))
    once = first_of_group(named, [signature, "sentence_id", "_pair"], [order], 1)
    hits = {"gold_positive_hits": F.col("gold_status") == "gold_positive", "gold_negative_hits": F.col("gold_status") == "gold_negative"}
    counts = once.groupBy(signature).agg(F.count(F.lit(1)).alias("sentence_pair_observations"), *(F.count_if(c).alias(n) for n, c in hits.items()))
    out = every.join(counts, signature)
    evaluable = F.col("gold_positive_hits") + F.col("gold_negative_hits")
    return out.withColumns({"no_gold_hits": F.col("sentence_pair_observations") - evaluable, "annotation_agreement": F.round(F.coalesce(F.try_divide("gold_positive_hits", evaluable), F.lit(0.0)), 6)})


def path_keys() -> dict[str, Column]:
    """The seven keys of a mined path (semantic_signature, construction, prep_signature, endpoint_edges, carrier_heads, typed_heads:
    array of structs head and categories), each finer than the one before; the last goes by the predicate."""
    empty = F.array().cast("array<string>")
    cleaned = lambda c: K.or_mark(c)
    edge = lambda e: F.concat_ws(":", e["protein_index"].cast("string"), cleaned(e["dep"]), cleaned(e["prep"]), cleaned(e["via_lemma"]))
    attached = first_text(F.array_join(F.array_sort(F.transform("endpoint_edges", edge)), "|"), F.lit("_"))
    carrier = first_text(F.array_join(F.coalesce("carrier_heads", empty), "+"), F.lit("_"))
    typed = first_text(F.array_join(F.transform("typed_heads", lambda h: F.concat(h["head"], F.lit(":"), F.array_join(h["categories"], ","))), "|"), F.lit("_"))
    built, prep = K.or_mark(F.col("construction")), first_text(F.coalesce("prep_signature", F.lit("")), F.lit("_"))
    predicate = first_text(F.coalesce("predicate_chain", F.lit("")), F.coalesce(F.get(F.split("semantic_signature", r"\|"), F.lit(1)), F.lit("")), F.lit("_"))
    tail = {"construction": built, "prep": prep, "attach": attached, "carrier": carrier, "typed_intermediates": typed}
    join = lambda *names: F.concat(*(F.concat(F.lit(f"|{n}="), tail[n]) for n in names))
    names, key = ["construction", "prep", "attach", "carrier", "typed_intermediates"], F.col("semantic_signature")
    out = {"semantic": key}
    for label, name in zip(("construction", "pp", "attachment", "carrier", "typed_intermediate"), names):
        key = F.concat(key, join(name))
        out[label] = key
    out["predicate_chain"] = F.concat(predicate, join("construction", "prep", "carrier", "typed_intermediates"))
    return out


def path_fields(kind: str) -> dict[str, Column]:
    """A path's fields from a proposed relation (kind `typed_rule`) or a mined path (`dep_mined`), named alike."""
    if kind == "typed_rule":
        part = lambda i, c: F.when(F.size(F.split(F.coalesce("canonical_pattern_key", F.lit("")), r"\|")) > i, K.key_part(F.col("canonical_pattern_key"), i)).otherwise(F.coalesce(c, F.lit("")))
        carried = F.when(F.coalesce(F.col("owner_propagated").cast("boolean"), F.lit(False)), F.coalesce("case_marker", F.lit(""))).otherwise("")
        return {"event_type": F.upper(first_text(F.coalesce("event_type", F.lit("")), F.lit("INTERACTION"))), "topology": F.lit("symmetric"), "anchor": part(2, "predicate_lemma"), "construction": part(4, "construction"),
                "prep": part(3, F.lit("")), "carrier_head": carried, "unmapped_reason": F.lit("")}
    if kind != "dep_mined":
        raise ValueError("kind is typed_rule or dep_mined")
    apex, carrier = F.coalesce("apex_lemma", F.lit("")), F.coalesce("carrier_signature", F.lit(""))
    prep = F.coalesce("prep_signature", F.lit(""))
    return {"event_type": F.lit(""), "topology": F.lit("dep_path"), "anchor": apex, "construction": F.coalesce("construction", F.lit("")), "prep": F.when(prep.isin("none", "", "_"), "").otherwise(F.split(prep, r"\|")[0]),
            "carrier_head": F.when(carrier.contains("+") | (carrier == "_"), "").otherwise(carrier), "unmapped_reason": F.when(apex == "", "no_anchor").when(carrier.contains("+"), "multi_carrier").otherwise("")}


def path_key() -> Column:
    """Type, topology, anchor and construction; the carrier is no part of it."""
    return F.concat_ws("|", first_text(F.col("event_type"), F.lit("?")), first_text(F.col("topology"), F.lit("?")), first_text(F.col("anchor"), F.lit("_")), first_text(F.col("construction"), F.lit("?")))


def rendered_path() -> Column:
    """A path's fields as text."""
    word = first_text(F.col("anchor"), F.lit("?"))
    link = F.when(F.col("prep").isin("", "_", "none"), "").otherwise(F.col("prep"))
    carrier, quoted = F.col("carrier_head"), F.concat(F.lit('"'), word, F.lit('"'))
    has, of = carrier != "", first_text(link, F.lit("of"))
    is_a = F.when(has, F.concat(F.lit('P0 [IS-A] "'), carrier, F.lit('" '), of, F.lit(" P1"))).when(F.lower(word).isin("is-a", "identity", "has", "part-of"), "P0 [IS-A] P1").otherwise(F.concat(F.lit("P0 [IS-A] "), quoted, F.lit(" P1")))
    right = F.when(has, F.concat(F.lit('("'), carrier, F.lit('" '), of, F.lit(" P1)"))).when(link != "", F.concat(link, F.lit(" P1"))).otherwise("P1")
    kind = F.upper("event_type")
    return F.when(kind == "INTERACTION_STATE", F.concat(F.lit("{P0, P1} "), quoted)).when(kind == "RELATION_STATEMENT", is_a).otherwise(F.trim(F.concat(F.lit("P0 "), quoted, F.lit(" "), right)))


def statement_chain(schema: Column, trigger: Column) -> Column:
    """A relational statement for display."""
    label, word = F.upper(first_text(F.coalesce(schema, F.lit("")), F.lit("RELATIONAL"))), F.replace(F.trim(F.coalesce(trigger, F.lit(""))), F.lit('"'), F.lit('\\"'))
    quoted = F.when(word != "", F.concat(F.lit(' "'), word, F.lit('"'))).otherwise("")
    named = label.isin("IS-A", "HAS", "PART-OF")
    return F.when(label == "IDENTITY", "[A] IDENTITY? [B]").otherwise(F.concat(F.lit("[A] "), F.when(named, label).otherwise(F.concat(F.lit("REL:"), label)), quoted, F.lit(" [B]")))


def pattern_chain(key: Column) -> Column:
    """A canonical pattern key for display; a key of other than five parts stays as it is."""
    evidence, shape, lemma, prep, built = (F.get(F.split(key, r"\|"), F.lit(i)) for i in range(5))
    case = F.when(prep.isin("", "_"), "").otherwise(prep)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    word = q(first_text(F.coalesce(lemma, F.lit("")), F.lit("_")))
    plain = (
        F.when(shape == "AA", F.concat(F.lit("[A+] "), word))
        .when(built == "passive", F.concat(F.lit("[B] "), word, F.lit(" "), q(first_text(case, F.lit("by"))), F.lit(" [A]")))
        .when((shape == "AB") & (case != ""), F.concat(F.lit("[A] "), word, F.lit(" "), q(case), F.lit(" [B]")))
        .when(shape == "NESTED", F.concat(F.lit("[[event]] "), word, F.lit(" [B]")))
        .when(shape == "RELATIONAL", F.concat(F.lit("[A] REL:"), word, F.lit(" [B]")))
        .otherwise(F.concat(F.lit("[A] "), word, F.lit(" [B]")))
    )
    schema = F.lower(F.trim(F.coalesce(lemma, F.lit(""))))
    said = F.when(schema.isin("is-a", "has", "part-of", "identity"), statement_chain(schema, F.lit(""))).otherwise(statement_chain(F.lit("IS-A"), lemma))
    return F.when(F.size(F.split(key, r"\|")) != 5, key).when(evidence == "relational", said).otherwise(plain)


def contextual_chain(chain: Column, word: Column, role: Column) -> Column:
    """A chain with the carrier word in the end that it belongs to: by role, else in the last end."""
    clean = F.replace(F.trim(F.coalesce(word, F.lit(""))), F.lit('"'), F.lit('\\"'))

    def within(mark: str, last: bool = False) -> Column:
        at = F.length(chain) - F.locate(mark[::-1], F.reverse(chain)) - len(mark) + 2 if last else F.locate(mark, chain)
        return F.concat(F.substr(chain, F.lit(1), at - 1), F.lit(mark[:-1] + ' "'), clean, F.lit('"]'), F.substr(chain, at + len(mark)))

    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    stated = chain.rlike(r" (IS-A|HAS|PART-OF|IDENTITY\?) ")
    first, second = chain.contains("[A]"), chain.contains("[B]")
    return (
        F.when(clean == "", chain)
        .when((stated | r.isin("sources", "source", "entities_a", "entity_a", "participants")) & first, within("[A]"))
        .when(r.isin("targets", "target", "entities_b", "entity_b") & second, within("[B]"))
        .when(second, within("[B]", True))
        .when(chain.contains("[A+]"), within("[A+]", True))
        .when(first, within("[A]", True))
        .otherwise(F.concat(chain, F.lit(' ["'), clean, F.lit('"]')))
    )
