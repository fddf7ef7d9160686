from pyspark.sql import functions as F

from accordant.operators import observations as O
from accordant.scratch import co_located

EVENT = f"sentence_id string, event_id string, predicate {O.CORE}, arguments array<{O.ARGUMENT}>"
FULL = ("a", "nmod:of", "", (3, [2, 1, 2]), [(5, [1], "nmod", "nmod:by"), (6, [], "", "compound"), (7, [9, 9], "x", "")], [(8, [4], "amod"), (9, [], "")], [(10, "Of"), (11, "")])


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def plain(df):
    return sorted(df.select("sentence_id", "event_id", F.to_json(F.struct("predicate", "arguments")).alias("j")).collect())


def test_round_trip(spark):
    df = events(
        spark,
        ("s", "e1", (1, [3]), [FULL, ("b", "", "e2", None, [], [], []), ("a", "", "", None, [], [], []), FULL]),
        ("s", "e2", None, []),
        ("s", "e3", (2, []), [("a", "x", "", (None, [1]), [], [], [])]),
        ("t", "e1", (4, [1, 1]), [FULL]),
    )
    assert plain(O.restore(O.project(df))) == plain(df)
    odd = events(spark, ("s", "e1", None, None), (None, "e9", None, [("a", None, None, None, None, None, None)]))
    back = {r.event_id: r.arguments for r in O.restore(O.project(odd.filter("sentence_id IS NOT NULL"))).collect()}
    assert back == {"e1": []}
    assert O.restore(O.project(df.filter("false"))).count() == 0


def test_links_and_bindings(spark):
    tables = O.project(events(spark, ("s", "e", (1, [3]), [FULL, FULL])))
    assert [r.argument_id for r in tables["arguments"].orderBy("ordinal").collect()] == ["e:a:0", "e:a:1"]
    links = {r.link_id: r for r in tables["links"].filter("argument_id = 'e:a:0'").collect()}
    first = links["e:a:0:mention:owner:0"]
    assert (first.relation, first.case, first.interpretation) == ("nmod", "by", "nmod_argument_with_case_by")
    assert links["e:a:0:mention:owner:1"].relation == "compound" and links["e:a:0:mention:owner:2"].source == O.UNTYPED
    assert links["e:a:0:mention:descriptor:1"].relation == "descriptor" and links["e:a:0:mention:case:0"].case == "Of"
    ids = {r.binding_id for r in tables["bindings"].filter("argument_id = 'e:a:0'").collect()}
    assert ids == {"e:a:0:binding:direct:1", "e:a:0:binding:direct:2", "e:a:0:binding:owner:0:1", "e:a:0:binding:owner:2:9", "e:a:0:binding:descriptor:0:4"}
    assert [r.entities for r in O.visible_entities(tables).collect()] == [[1, 2, 4, 9]] * 2
    assert {r.mention_id: r.referents for r in tables["mentions"].collect()} == {"e:predicate": [3], "e:a:0:mention": [1, 2], "e:a:1:mention": [1, 2]}


def test_sentence_graph(spark):
    schema = "sentence_id string, i int, word string, lemma string, dep string, head_i int, char_start int, char_end int, direct array<int>, entities array<int>, kind string, reference_head int"
    rows = [
        ("s", 0, "PROTEIN0", "", "nsubj", 1, 0, 8, [], [0], None, None),
        ("s", 1, "acts", "act", "root", -1, 9, 13, [], [], None, None),
        ("s", 2, "it", "it", "obj", 1, 14, 16, [], [0], "pronoun_coreference", 0),
        ("s", 3, "Of", "Of", "case", 2, 17, 19, [], [], None, None),
        ("s", 4, "out", None, "case", 2, 20, 23, [], [], None, None),
        ("s", 5, "X", "x", "conj", 9, 24, 25, [7], [7], None, None),
    ]
    nodes = spark.createDataFrame(rows, schema)
    mentions = {r.i: (r.mention_kind, r.direct, r.inherited) for r in O.parser_mentions(nodes).collect()}
    assert mentions[0] == ("direct_protein_marker", [0], []) and mentions[2] == ("reference_bearing_anchor", [], [0])
    assert mentions[5] == ("reference_bearing_anchor", [7], []) and mentions[1] == ("lexical_anchor", [], [])
    links = {r.link_id: (r.relation, r.case) for r in O.parser_links(nodes).collect()}
    assert links == {"s:dep:1->0": ("nsubj", ""), "s:dep:1->2": ("obj", "of out"), "s:dep:2->3": ("case", ""), "s:dep:2->4": ("case", ""), "s:reference:2->0": ("reference:pronoun_coreference", "")}
    tree = {r.i: r.head_i for r in O.tree_of_links(O.parser_mentions(nodes), O.parser_links(nodes)).collect()}
    assert tree == {0: 1, 1: -1, 2: 1, 3: 2, 4: 2, 5: -1}
    spans = spark.createDataFrame([("s", 0, 0, "pronoun", 9, 15), ("s", 0, 1, "pronoun", 90, 99)], "sentence_id string, cluster int, mention int, evidence_type string, start int, end int")
    assert {r.mention: r.node_refs for r in O.parser_clusters(nodes, spans).collect()} == {0: ["s:node:1:9-13", "s:node:2:14-16"], 1: []}


def test_bindings_read_the_events_once(spark):
    """One pass over the events gives direct and linked bindings, and tables of dealt events stay dealt: no shuffle."""
    df = events(spark, ("s", "e1", (1, [3]), [FULL]), ("s", "e2", None, [])).repartition(3, "event_id")
    tables = O.project(df, named=True)
    with co_located(spark):
        plans = {n: t._jdf.queryExecution().executedPlan().toString() for n, t in {"bindings": tables["bindings"], "shown": O.visible_entities(tables)}.items()}
    assert plans["bindings"].count("Exchange hashpartitioning") == 1 and "Union" not in plans["bindings"]
    assert plans["shown"].count("Exchange hashpartitioning") == 3  # the given dealing of each table, none for its joins
    assert {r.argument_id: list(r.entities) for r in O.visible_entities(tables).collect()} == {"e1:a:0": [1, 2, 4, 9]}
