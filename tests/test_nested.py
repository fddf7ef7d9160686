from pyspark.sql import functions as F

from accordant.operators import nested as N

NODES = "sentence_id string, i int, lemma string, word string, pos string, dep string, head_i int, entities array<int>"


def built(spark, *words, nominals=("interaction",)):
    """Words as (lemma, pos, dep, head, entities)."""
    nodes = spark.createDataFrame([("s", i, w, w, pos, dep, head, list(e)) for i, (w, pos, dep, head, e) in enumerate(words)], NODES)
    return N.inner_events(nodes, list(nominals))


def sides(args):
    out = {}
    for r in sorted(args.collect(), key=lambda r: (r.head, r.ordinal)):
        out.setdefault(r.head, {}).setdefault(r.slot, []).append((r.i, r.prep))
    return out


HEAD = ("interaction", "NOUN", "root", -1, [])


def test_sides(spark):
    of_by = [HEAD, ("of", "ADP", "case", 2, []), ("A", "PROPN", "nmod:of", 0, [1]), ("by", "ADP", "case", 4, []), ("B", "PROPN", "nmod", 0, [2])]
    assert sides(built(spark, *of_by)[1]) == {0: {"targets": [(2, "of")], "sources": [(4, "by")]}}
    with_ = [HEAD, ("with", "ADP", "case", 2, []), ("A", "PROPN", "nmod", 0, [1]), ("B", "PROPN", "conj", 2, [2]), ("C", "PROPN", "conj", 3, [3])]
    assert sides(built(spark, *with_)[1]) == {0: {"participants": [(2, "with"), (3, "with"), (4, "with")]}}
    compound = [HEAD, ("A", "PROPN", "compound", 0, [1]), ("with", "ADP", "case", 3, []), ("B", "PROPN", "nmod", 0, [2])]
    assert sides(built(spark, *compound)[1]) == {0: {"sources": [(1, "")], "targets": [(3, "with")]}}
    two = [HEAD, ("of", "ADP", "case", 2, []), ("A", "PROPN", "nmod", 0, [1]), ("to", "ADP", "case", 4, []), ("B", "PROPN", "nmod", 0, [2]), ("C", "PROPN", "compound", 0, [3])]
    assert sides(built(spark, *two)[1]) == {0: {"sources": [(2, "of")], "targets": [(4, "to"), (5, "")]}}


def test_few_names_and_depth(spark):
    assert sides(built(spark, HEAD, ("A", "PROPN", "compound", 0, [1]), ("A", "PROPN", "nmod", 0, [1]))[1]) == {}
    chain = [HEAD] + [("A", "PROPN", "nmod", k, [k]) for k in range(5)]
    assert [i for i, _ in sides(built(spark, *chain)[1])[0]["participants"]] == [1, 2, 3]
    assert sides(built(spark, *chain, nominals=())[1]) == {}


def test_claims_and_control(spark):
    events, args = built(spark, HEAD, ("with", "ADP", "case", 2, []), ("A", "PROPN", "nmod", 0, [1]), ("B", "PROPN", "conj", 2, [2]), ("form", "VERB", "root", -1, []), ("X", "PROPN", "nsubj", 4, [7]))
    claims = N.claimed(spark.createDataFrame([("s", 9, 0, "obl:by"), ("s", 4, 0, "obj"), ("s", 4, 0, "obl:in")], "sentence_id string, outer int, head int, role string"))
    assert [(r.outer, r.role) for r in claims.collect()] == [(4, "obj")]
    assert N.unconsumed(events, claims).count() == 0
    sources = spark.createDataFrame([("s", 4, 5, [7])], "sentence_id string, outer int, i int, entities array<int>")
    for lemma, role, rule in (("form", "obj", N.SUBJECT_RULE), ("form", "obl:in", N.SUBJECT_RULE), ("show", "obl:via", N.ADJUNCT_RULE), ("show", "obj", None), ("form", "obl:of", None)):
        told = claims.withColumn("lemma", F.lit(lemma)).withColumn("role", F.lit(role))
        out, moved = N.control(events, args, told, sources)
        assert out.first().rule_id == rule and out.first().directed == (rule is not None)
        assert sides(moved)[0] == ({"sources": [(5, "")], "targets": [(2, "with"), (3, "with")]} if rule else {"participants": [(2, "with"), (3, "with")]})


def test_levels(spark):
    events = spark.createDataFrame([("s", n, [n]) for n in range(8)] + [("t", 1, None)], "sentence_id string, event int, entities array<int>")
    refs = [("s", 0, 1), ("s", 0, 2), ("s", 1, 3), ("s", 2, 3), ("s", 4, 5), ("s", 5, 4), ("s", 6, 4), ("s", 7, 99), ("t", 99, 1), ("s", 0, 1)]
    got = {(r.sentence_id, r.event): (r.level, r.all_entities, r.cyclic) for r in N.compose(events, spark.createDataFrame(refs, "sentence_id string, outer int, inner int")).collect()}
    assert got == {
        ("s", 3): (0, [3], False), ("s", 7): (0, [7], False), ("t", 1): (0, [], False), ("s", 1): (1, [1, 3], False), ("s", 2): (1, [2, 3], False), ("s", 0): (2, [0, 1, 2, 3], False),
        ("s", 4): (None, None, True), ("s", 5): (None, None, True), ("s", 6): (None, None, True),
    }
    assert N.compose(events.filter("false"), spark.createDataFrame(refs, "sentence_id string, outer int, inner int")).count() == 0


def test_long_chains_are_no_cycles(spark):
    """However far events refer on: a chain of 12 references has 12 levels, a ring of 12 none."""
    from accordant.operators import nested

    events = spark.createDataFrame([(s, k, [k]) for s in ("chain", "ring") for k in range(13)], "sentence_id string, event int, entities array<int>")
    refs = spark.createDataFrame([(s, k, (k + 1) % 13) for s in ("chain", "ring") for k in range(13) if s == "ring" or k < 12], "sentence_id string, outer int, inner int")
    got = {(r.sentence_id, r.event): (r.cyclic, r.level, r.all_entities) for r in nested.compose(events, refs).collect()}
    assert all(got["chain", k] == (False, 12 - k, list(range(k, 13))) and got["ring", k] == (True, None, None) for k in range(13))
