import json

import pytest
from pyspark.sql import functions as F

from accordant.operators import references as R
from accordant.operators import rules

NODES = "sentence_id string, i int, word string, lemma string, pos string, dep string, head_i int, char_start int, char_end int, direct array<int>, entities array<int>"
MENTIONS = "sentence_id string, cluster int, mention int, evidence_type string, start int, end int"


def sentence(spark, *words, name="s"):
    """Words as (word, lemma, pos, dep, head, entities); each is ten characters wide."""
    rows = [(name, i, w, lemma, pos, dep, head, 10 * i, 10 * i + 9, list(e), list(e)) for i, (w, lemma, pos, dep, head, e) in enumerate(words)]
    return spark.createDataFrame(rows, NODES)


def spans(spark, *rows):
    return spark.createDataFrame([("s", c, m, kind, 10 * a, 10 * b + 9) for c, m, kind, a, b in rows], MENTIONS)


def got(nodes):
    return {r.i: (r.entities, r.kind) for r in nodes.collect() if r.kind}


AND = [("A", "A", "PROPN", "nsubj", 3, [4]), ("and", "and", "CCONJ", "cc", 2, []), ("B", "B", "PROPN", "conj", 0, [2])]


@pytest.mark.parametrize("pronoun, first, expected", [("they", 0, [2, 4]), ("it", 0, None), ("which", 0, [2, 4]), ("it", 2, [2])])
def test_number(spark, pronoun, first, expected):
    nodes = sentence(spark, *AND, ("bind", "bind", "VERB", "root", -1, []), (pronoun, pronoun, "PRON", "obj", 3, []))
    out, said = R.pronouns(nodes, spans(spark, (0, 0, "pronoun", first, 2), (0, 1, "pronoun", 4, 4), (1, 0, "nominal", 0, 0), (1, 1, "nominal", 4, 4)))
    assert got(out) == ({4: (expected, R.KINDS["pronoun"])} if expected else {})
    row = said.select("application.*").first()
    assert row.decision == ("applied" if expected else "blocked") and json.loads(row.evidence)["antecedent_protein_indices"] == ([2, 4] if first == 0 else [2])
    if first == 2:
        r = out.filter("i = 4").first()
        assert r.reference_head == 2 and r.reference_nodes == [2]


def test_which_needs_an_explicit_coordination(spark):
    """Two entities of a span that isn't coordinated: a clause."""
    nodes = sentence(spark, ("A", "A", "PROPN", "nsubj", 1, [0]), ("binds", "bind", "VERB", "root", -1, []), ("B", "B", "PROPN", "obj", 1, [1]), ("which", "which", "PRON", "nsubj", 1, []))
    out, said = R.pronouns(nodes, spans(spark, (0, 0, "pronoun", 0, 2), (0, 1, "pronoun", 3, 3)))
    assert got(out) == {} and said.first().application.reason == R.NO_PLURAL


def test_later_cluster_counts_and_named_pronouns_stay(spark):
    nodes = sentence(spark, ("A", "A", "PROPN", "x", -1, [0]), ("B", "B", "PROPN", "x", -1, [1]), ("it", "it", "PRON", "x", 0, []), ("this", "this", "DET", "x", 0, []), ("it", "it", "PRON", "x", 0, [5]))
    many = spans(spark, (0, 0, "pronoun", 0, 0), (0, 1, "pronoun", 2, 2), (1, 0, "pronoun", 1, 1), (1, 1, "pronoun", 2, 2), (1, 2, "pronoun", 3, 3), (2, 0, "pronoun", 0, 0), (2, 1, "pronoun", 4, 4))
    out, _ = R.pronouns(nodes, many)
    assert got(out) == {2: ([1], R.KINDS["pronoun"]), 3: ([1], R.KINDS["pronoun"])}


def is_a(spark, *words):
    out, said = R.is_a(sentence(spark, *words), ["protein", "receptor"], ["level"])
    return got(out), [r.application.reason for r in said.orderBy("i").collect()]


COPULA = [("A", "A", "PROPN", "nsubj", 3, [0]), ("is", "be", "AUX", "cop", 3, []), ("a", "a", "DET", "det", 3, []), ("kinase", "kinase", "NOUN", "root", -1, [])]
LATER = [("the", "the", "DET", "det", 5, []), ("kinase", "kinase", "NOUN", "nsubj", 6, []), ("acts", "act", "VERB", "x", -1, [])]


def test_copula(spark):
    assert is_a(spark, *COPULA, *LATER) == ({5: ([0], R.KINDS["is_a"])}, [R.UNIQUE])
    assert is_a(spark, *COPULA, ("a", "a", "DET", "det", 5, []), *LATER[1:]) == ({}, [])
    # A name of its own within the nominal.
    assert is_a(spark, *COPULA, *LATER[:2], ("B", "B", "PROPN", "compound", 5, [3])) == ({}, [])
    assert is_a(spark, *LATER[:1], *LATER[1:2], *LATER[2:]) == ({}, [])


def test_ambiguous_and_cardinality(spark):
    appos = [("B", "B", "PROPN", "x", -1, [1]), ("kinase", "kinase", "NOUN", "appos", 4, [])]
    assert is_a(spark, *COPULA, *appos, ("the", "the", "DET", "det", 7, []), ("kinase", "kinase", "NOUN", "x", -1, [])) == ({}, [R.AMBIGUOUS])
    two = [("A", "A", "PROPN", "nsubj", 3, [0]), ("B", "B", "PROPN", "conj", 0, [1]), ("are", "be", "AUX", "cop", 3, []), ("kinases", "kinase", "NOUN", "root", -1, [])]
    one = [("the", "the", "DET", "det", 5, []), ("kinase", "kinase", "NOUN", "x", -1, [])]
    assert is_a(spark, *two, *one) == ({}, [R.CARDINALITY])
    assert is_a(spark, *two, one[0], ("kinases", "kinase", "NOUN", "x", -1, [])) == ({5: ([0, 1], R.KINDS["is_a"])}, [R.UNIQUE])
    assert is_a(spark, *two, ("these", "these", "DET", "det", 5, []), one[1]) == ({5: ([0, 1], R.KINDS["is_a"])}, [R.UNIQUE])


def test_transparent_owner(spark):
    words = [("level", "level", "NOUN", "root", -1, []), ("of", "of", "ADP", "case", 2, []), ("A", "A", "PROPN", "nmod", 0, [7]), ("the", "the", "DET", "det", 4, []), ("protein", "protein", "NOUN", "appos", 0, []), ("the", "the", "DET", "det", 6, []), ("protein", "protein", "NOUN", "x", -1, [])]
    found, reasons = is_a(spark, *words)
    assert found == {6: ([7], R.KINDS["is_a"])} and reasons == [R.UNIQUE]


def test_the_nearest_group_that_does_not_fit_is_passed_over(spark):
    three = [("C", "C", "PROPN", "x", -1, [5]), ("D", "D", "PROPN", "conj", 3, [6]), ("E", "E", "PROPN", "conj", 3, [7])]
    rest = [("these", "these", "DET", "det", 8, []), ("two", "two", "NUM", "nummod", 8, []), ("proteins", "protein", "NOUN", "x", -1, [])]
    assert got(R.demonstratives(sentence(spark, *AND, *three, *rest))) == {8: ([2, 4], R.KINDS["group"])}
    four = [*rest[:1], ("4", "4", "NUM", "nummod", 8, []), rest[2]]
    assert got(R.demonstratives(sentence(spark, *AND, *three, *four))) == {}
    again = sentence(spark, *three[:0], *AND, *three, *rest).withColumn("direct", F.lit(None).cast("array<int>"))
    assert got(R.demonstratives(again)) == {8: ([2, 4], R.KINDS["group"])}


def test_empty(spark):
    none = spark.createDataFrame([], NODES)
    nodes, said = R.resolve(none, spark.createDataFrame([], MENTIONS), [], [])
    assert nodes.count() == said.count() == 0


def test_toggles(spark):
    rows = spark.createDataFrame([("a.b.c@1",), ("a.b@1",), ("a.bc.d@1",), ("x.y@2",)], "rule_id string")
    toggles = lambda *t: spark.createDataFrame(list(t), "prefix string, exact boolean, enabled boolean")
    on = lambda t: {r.rule_id for r in rules.with_enabled(rows, t).filter("enabled").collect()}
    assert on(toggles(("a.b", False, False))) == {"a.b@1", "a.bc.d@1", "x.y@2"}
    assert on(toggles(("a.", False, False), ("a.b..", False, True), ("x.y@2", True, False))) == {"a.b.c@1"}
    assert on(toggles(("x.y@2", False, False), ("", False, False), ("a.b", True, False))) == {"a.b.c@1", "a.b@1", "a.bc.d@1"}
    assert on(toggles(("a.b.c@1", True, True), ("a", False, False), ("x", False, True), ("x", False, False))) == {"a.b.c@1"}


def test_applications_are_checked_and_appended(spark):
    row = spark.range(1)
    for bad in (("no", "s", "applied"), ("a.b@1", " ", "applied"), ("a.b@1", "s", "perhaps")):
        with pytest.raises(Exception, match="no rule id|needs a stage|no decision"):
            row.select(rules.application(*map(F.lit, bad), F.lit(None), {})).collect()
    made = row.select("id", F.explode(F.array(F.lit(2), F.lit(1))).alias("n")).withColumn("application", rules.application(F.lit("a.b@1"), F.lit("s"), F.lit("applied"), F.lit(None).cast("string"), {"z": F.col("n"), "b": F.lit('"')}))
    once = rules.appended(row, ["id"], made, ["n"])
    twice = rules.appended(once, ["id"], made, ["n"]).first().trace
    assert [x.evidence for x in twice] == ['{"b":"\\"","z":1}', '{"b":"\\"","z":2}'] * 2
    assert rules.appended(row, ["id"], made.filter("false"), ["n"]).first().trace == []


def test_blocking_ends_a_run(spark):
    toggles = spark.createDataFrame([("c", False, False)], "prefix string, exact boolean, enabled boolean")
    odd = F.when(F.col("id") % 2 == 1, "odd")
    steps = [("a.b@1", "s", F.col("id") > 0, odd, {"id": F.col("id")}), ("c.d@1", "s", F.lit(True), F.lit("never"), {}), ("e.f@3", "t", F.lit(True), F.lit(None).cast("string"), {})]
    got = {r.id: ([(a.rule_id, a.decision) for a in r.trace], r.blocked) for r in rules.run(spark.range(3), ["id"], steps, toggles).collect()}
    assert got == {0: ([("e.f@3", "applied")], None), 1: ([("a.b@1", "blocked")], "a.b@1"), 2: ([("a.b@1", "applied"), ("e.f@3", "applied")], None)}


def test_spans_meet_the_nodes_of_their_stretch(spark):
    """Spans that begin before the sentence, end far beyond it or lie outside give the nodes within; a span meets no node of another stretch."""
    nodes = spark.createDataFrame([("s", i, i * 10, i * 10 + 9) for i in range(100)], "sentence_id string, i int, char_start int, char_end int")
    spans = [("s", 0, -80, 9), ("s", 1, 60, 69), ("s", 2, 55, 139), ("s", 3, 980, 2**40), ("s", 4, 5000, 6000), ("s", 5, 20, 5), ("t", 6, 0, 9), ("s", 7, -500, -100)]
    out = R._within(spark.createDataFrame(spans, "sentence_id string, mention int, start long, end long"), nodes)
    found = {}
    for r in out.collect():
        found.setdefault(r.mention, []).append(r.i)
    assert {k: sorted(v) for k, v in found.items()} == {0: [0], 1: [6], 2: list(range(6, 14)), 3: [98, 99]}
    assert "_at" in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]  # by stretch, not by sentence alone
