"""Events as graphs: typed tables of mentions, links, arguments and binding proposals, the views that give the events back, and the graph of a parsed sentence.

An event is a row: sentence_id, event_id, predicate (node, entities; null for none) and arguments, an array in order of slot, role, event_ref
(not empty where the argument is another event), core (node, entities), owners (node, entities, dep, source), descriptors (node, entities, dep) and
cases (node, lemma). `project` makes the tables by expressions over the row; nothing is shuffled. Every table carries the ordinals of what it
was made from, so that `restore` gives the event exactly: by one aggregation of the links by mention, and one of the arguments by event.

A null array counts as empty, a null text as '', a null event_id as ''. An argument that is an event has no mention: its core, owners, descriptors and cases aren't kept. Events with equal
sentence_id and event_id would be one: they must differ. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import union

# Kinds, operations and interpretations.
INTERPRETATIONS = {"compound": "compound_modifier_represents_head", "complex_conj": "coordinate_member_represents_argument", "apposition": "apposition_identity", "hyphen_modifier": "hyphen_modifier_represents_argument"}
LINKED, UNTYPED = "linked_referent_represents_argument", "untyped_owner_without_provenance"
DESCRIPTOR, DESCRIPTOR_REFERENT = "descriptor_modifier", "descriptor_referent_represents_argument"

CORE = "struct<node:int,entities:array<int>>"
OWNER, DESCRIBED, CASE = "struct<node:int,entities:array<int>,dep:string,source:string>", "struct<node:int,entities:array<int>,dep:string>", "struct<node:int,lemma:string>"
ARGUMENT = f"struct<slot:string,role:string,event_ref:string,core:{CORE},owners:array<{OWNER}>,descriptors:array<{DESCRIBED}>,cases:array<{CASE}>>"
GIVEN = "struct<kind:string,ordinal:int,node:int,entities:array<int>,dep:string,source:string>"
KEY = ["sentence_id", "event_id"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _ints(c: Column) -> Column:
    return _list(c, "int")


def _referents(c: Column) -> Column:
    distinct = F.array_distinct(_ints(c))
    return F.when(F.size(distinct) > 1, F.array_sort(distinct)).otherwise(distinct)


def owner_interpretation(source: Column) -> Column:
    """What an owner stands for, by where it came from."""
    after = F.substring_index(source, "nmod:", -1)
    known = F.create_map(*(F.lit(x) for pair in INTERPRETATIONS.items() for x in pair))
    return F.when(source.startswith("nmod:"), F.concat(F.lit("nmod_argument_with_case_"), F.when(after == "", "_").otherwise(after))).otherwise(F.coalesce(F.element_at(known, source), F.lit(LINKED)))


def _links(arg: Column) -> Column:
    """The links of an argument's mention as they are given: owners, descriptors and case markers, each with its place among its kind."""
    empty = F.lit("")
    parts = [
        (arg["owners"], OWNER, lambda o, k: F.struct(F.lit("owner"), k, o["node"], _ints(o["entities"]), o["dep"], o["source"])),
        (arg["descriptors"], DESCRIBED, lambda d, k: F.struct(F.lit("descriptor"), k, d["node"], _ints(d["entities"]), d["dep"], empty)),
        (arg["cases"], CASE, lambda m, k: F.struct(F.lit("case_marker"), k, m["node"], F.array().cast("array<int>"), m["lemma"], empty)),
    ]
    return F.concat(*(F.transform(_list(c, kind), make).cast(f"array<{GIVEN}>") for c, kind, make in parts))


def _described(links: DataFrame) -> DataFrame:
    """Rows with a link (l) as it is given, with what it says in its place: read off the row, not within the array."""
    owner, descriptor = F.col("l.kind") == "owner", F.col("l.kind") == "descriptor"
    source, said = F.when(_text(F.col("l.source")) == "", UNTYPED).otherwise(F.col("l.source")), _text(F.col("l.dep"))
    nmod = source.startswith("nmod:")
    fields = {
        "dep": F.when(owner | descriptor, said).otherwise(""),
        "relation": F.when(owner, F.when(said != "", said).when(nmod, "nmod").otherwise(source)).when(descriptor, F.when(said == "", "descriptor").otherwise(said)).otherwise("case"),
        "case": F.when(owner, F.when(nmod, F.substring_index(source, "nmod:", -1)).otherwise("")).when(descriptor, "").otherwise(said),
        "source": F.when(owner, source).otherwise(""),
        "interpretation": F.when(owner, owner_interpretation(source)).when(descriptor, DESCRIPTOR).otherwise(""),
    }
    return links.select(*(c for c in links.columns if c != "l"), *(F.col(f"l.{n}") for n in ("kind", "ordinal", "node", "entities")), *(c.alias(n) for n, c in fields.items()))


def _event_id(named: bool) -> Column:
    """A column as it is keeps what the rows are dealt by; with a default in the place of null it's another one."""
    return (F.col("event_id") if named else _text(F.col("event_id"))).alias("event_id")


def arguments(events: DataFrame, named: bool = False) -> DataFrame:
    """A row an argument: its id, slot, ordinals within the event and the slot, the mention that fills it or the event that it refers to, its role, and the argument (a)."""
    rows = events.select("sentence_id", _event_id(named), F.col("arguments").cast(f"array<{ARGUMENT}>").alias("_all")).select(*KEY, F.col("_all.slot").alias("_slots"), F.posexplode("_all").alias("ordinal", "a"))
    index = F.coalesce(F.col("ordinal") - F.size(F.array_remove(F.slice("_slots", F.lit(1), F.col("ordinal")), F.col("a.slot"))), F.lit(0))
    argument = F.concat_ws(":", "event_id", "a.slot", index.cast("string"))
    is_event = _text(F.col("a.event_ref")) != ""
    return rows.select(
        *KEY, argument.alias("argument_id"), "ordinal", F.col("a.slot").alias("slot"), index.alias("slot_ordinal"),
        F.when(is_event, "").otherwise(F.concat(argument, F.lit(":mention"))).alias("mention_id"), _text(F.col("a.event_ref")).alias("event_ref"), _text(F.col("a.role")).alias("role"), "a",
    )


def project(events: DataFrame, named: bool = False) -> dict[str, DataFrame]:
    """The tables of events: events, arguments, mentions, links and bindings. named says that no event_id is null: then tables of events that are dealt by it are dealt alike."""
    args = arguments(events, named)
    filled = args.filter("mention_id <> ''")
    own = events.select("sentence_id", _event_id(named), F.col("predicate").cast(CORE).alias("p"))
    predicates = own.filter("p IS NOT NULL").select(*KEY, F.concat("event_id", F.lit(":predicate")).alias("mention_id"), F.lit("predicate").alias("kind"), F.lit(True).alias("headed"), F.col("p.node").alias("node"), _ints(F.col("p.entities")).alias("entities"), _referents(F.col("p.entities")).alias("referents"))
    core = F.col("a.core")
    mentions = filled.select(*KEY, "mention_id", F.lit("argument").alias("kind"), core.isNotNull().alias("headed"), core["node"].alias("node"), _ints(core["entities"]).alias("entities"), _referents(core["entities"]).alias("referents"))
    link_id = F.concat_ws(":", "mention_id", F.when(F.col("kind") == "case_marker", "case").otherwise(F.col("kind")), F.col("ordinal").cast("string"))
    links = _described(filled.select(*KEY, "argument_id", "mention_id", F.explode(_links(F.col("a"))).alias("l")))
    links = links.select(*KEY, "argument_id", "mention_id", link_id.alias("link_id"), *links.columns[4:])
    # An argument's own entities stand beside its links, so that its events are read once for all bindings.
    own_core = F.array(F.struct(F.lit("direct"), F.lit(0), core["node"], _ints(core["entities"]), F.lit(""), F.lit(""))).cast(f"array<{GIVEN}>")
    given = filled.select(*KEY, "argument_id", "mention_id", F.explode(F.concat(own_core, _links(F.col("a")))).alias("l")).filter("l.kind <> 'case_marker'")
    direct = F.col("kind") == "direct"
    bindings = _described(given).select("*", F.explode(F.array_distinct("entities")).alias("referent")).select(
        *KEY, F.when(direct, F.concat_ws(":", "argument_id", F.lit("binding:direct"), F.col("referent").cast("string"))).otherwise(F.concat_ws(":", "argument_id", F.lit("binding"), "kind", F.col("ordinal").cast("string"), F.col("referent").cast("string"))).alias("binding_id"),
        "argument_id", "referent", F.when(direct, "bind_direct_referent").otherwise("bind_linked_referent").alias("operation"),
        F.when(direct, "direct_identity").when(F.col("kind") == "owner", F.col("interpretation")).otherwise(DESCRIPTOR_REFERENT).alias("interpretation"), F.when(direct, "").otherwise(link_id).alias("link_id"),
    )
    return {"events": own.select(*KEY), "arguments": args.drop("a"), "mentions": predicates.unionByName(mentions), "links": links, "bindings": bindings}


def _of_kind(kind: str, fields: str, make) -> Column:
    """The links of a kind in their order, as an aggregate."""
    found = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", *fields.split(",")))))
    return F.transform(found, make)


def dependents(links: DataFrame) -> DataFrame:
    """owners, descriptors and cases of each mention with links, in their order."""
    source = lambda x: F.when(x["source"] == UNTYPED, "").otherwise(x["source"])
    return links.groupBy(*KEY, "mention_id").agg(
        _of_kind("owner", "node,entities,dep,source", lambda x: F.struct(x["node"], x["entities"], x["dep"], source(x))).cast(f"array<{OWNER}>").alias("owners"),
        _of_kind("descriptor", "node,entities,dep", lambda x: F.struct(x["node"], x["entities"], x["dep"])).cast(f"array<{DESCRIBED}>").alias("descriptors"),
        _of_kind("case_marker", "node,case", lambda x: F.struct(x["node"], x["case"])).cast(f"array<{CASE}>").alias("cases"),
    )


def visible_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """argument_id and the sorted entities that it shows: its mention's own and those of its owners and descriptors."""
    own = tables["mentions"].filter("kind = 'argument'").select(*KEY, "mention_id", F.col("entities").alias("_own"))
    linked = tables["links"].filter("kind <> 'case_marker'").groupBy(*KEY, "mention_id").agg(F.flatten(F.collect_list("entities")).alias("_linked"))
    args = tables["arguments"].filter("mention_id <> ''").select(*KEY, "mention_id", "argument_id").join(own, [*KEY, "mention_id"]).join(linked, [*KEY, "mention_id"], "left")
    return args.select(*KEY, "argument_id", _referents(F.concat(_ints(F.col("_own")), _ints(F.col("_linked")))).alias("entities"))


def restore(tables: dict[str, DataFrame]) -> DataFrame:
    """The events that the tables were made of."""
    cores = tables["mentions"].select(*KEY, "mention_id", F.when(F.col("headed"), F.struct("node", "entities")).alias("core"))
    args = tables["arguments"].join(cores, [*KEY, "mention_id"], "left").join(dependents(tables["links"]), [*KEY, "mention_id"], "left")
    one = F.struct("slot", "role", "event_ref", "core", *(_list(F.col(n), k).alias(n) for n, k in (("owners", OWNER), ("descriptors", DESCRIBED), ("cases", CASE))))
    args = args.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("a")))), lambda x: x["a"]).cast(f"array<{ARGUMENT}>").alias("arguments"))
    predicates = tables["mentions"].filter("kind = 'predicate'").select(*KEY, F.struct("node", "entities").alias("predicate"))
    return tables["events"].join(predicates, KEY, "left").join(args, KEY, "left").select(*KEY, "predicate", _list(F.col("arguments"), ARGUMENT).alias("arguments"))


# ---- the graph of a parsed sentence -----------------------------------------------------------


def node_id() -> Column:
    return F.concat(F.col("sentence_id"), F.lit(":node:"), F.col("i").cast("string"), F.lit(":"), F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string"))


def parser_mentions(nodes: DataFrame) -> DataFrame:
    """A mention a node of a parsed and resolved sentence: its id, kind, and its direct and inherited referents."""
    marker, entities = F.col("word").rlike("(?i)^PROTEIN[0-9]+$"), _referents(F.col("entities"))
    direct, inherited = _referents(F.col("direct")), F.when(F.col("kind").isNotNull(), entities).otherwise(F.array().cast("array<int>"))
    bare = (F.size(direct) == 0) & (F.size(inherited) == 0)
    none = F.array().cast("array<int>")
    kind = F.when(marker, "direct_protein_marker").when(F.size(entities) > 0, "reference_bearing_anchor").otherwise("lexical_anchor")
    return nodes.select("sentence_id", "i", node_id().alias("mention_id"), kind.alias("mention_kind"), F.when(bare & marker, entities).otherwise(direct).alias("direct"), F.when(bare, F.when(marker, none).otherwise(entities)).otherwise(inherited).alias("inherited"))


def parser_links(nodes: DataFrame) -> DataFrame:
    """An edge from each node's head to it, with its case markers in order, and one from each node that refers to a mention to that mention's head."""
    slim = nodes.select("sentence_id", "i", "dep", "head_i", node_id().alias("id"))
    heads = slim.select("sentence_id", F.col("i").alias("head_i"), F.col("id").alias("source"))
    marks = nodes.filter("dep = 'case'").select("sentence_id", F.col("head_i").alias("i"), F.struct(F.col("i").alias("k"), F.lower(F.coalesce(F.nullif("lemma", F.lit("")), "word")).alias("w")).alias("m"))
    cases = marks.groupBy("sentence_id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["w"]), " ").alias("case"))
    name = lambda kind, a, b: F.concat(F.col("sentence_id"), F.lit(f":{kind}:"), a.cast("string"), F.lit("->"), b.cast("string"))
    edges = slim.filter("head_i >= 0 AND head_i <> i").join(heads, ["sentence_id", "head_i"]).join(cases, ["sentence_id", "i"], "left")
    edges = edges.select("sentence_id", name("dep", F.col("head_i"), F.col("i")).alias("link_id"), "source", F.col("id").alias("target"), F.col("dep").alias("relation"), _text(F.col("case")).alias("case"))
    referring = nodes.filter("reference_head >= 0").select("sentence_id", "i", F.col("reference_head").alias("head_i"), "kind", node_id().alias("id")).join(heads.withColumnRenamed("source", "target"), ["sentence_id", "head_i"])
    referring = referring.select("sentence_id", name("reference", F.col("i"), F.col("head_i")).alias("link_id"), F.col("id").alias("source"), "target", F.concat(F.lit("reference:"), F.coalesce("kind", F.lit("reference"))).alias("relation"), F.lit("").alias("case"))
    return union([edges, referring])


def parser_clusters(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each mention of a cluster with the ids of the nodes that overlap it, in order; without any too."""
    slim = nodes.select("sentence_id", "i", "char_start", "char_end", node_id().alias("id"))
    met = mentions.join(slim, "sentence_id").filter("char_start < end AND char_end > start").groupBy("sentence_id", "cluster", "mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("node_refs"))
    return mentions.join(met, ["sentence_id", "cluster", "mention"], "left").withColumn("node_refs", F.coalesce("node_refs", F.array().cast("array<string>")))


def tree_of_links(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """head_i and dep of every node, from the graph: the inverse of parser_links for trees."""
    ids = mentions.select("sentence_id", F.col("mention_id").alias("target"), "i")
    below = links.filter("NOT startswith(relation, 'reference:')").join(mentions.select("sentence_id", F.col("mention_id").alias("source"), F.col("i").alias("head_i")), ["sentence_id", "source"])
    return ids.join(below.select("sentence_id", "target", "head_i", F.col("relation").alias("dep")), ["sentence_id", "target"], "left").select("sentence_id", "i", F.coalesce("head_i", F.lit(-1)).alias("head_i"), "dep")
