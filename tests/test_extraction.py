import pytest
from pyspark.sql import functions as F

from accordant.operators import extraction as E

SCHEMA = f"sentence_id string, nodes {E.NODES}"


def parse(text):
    """word/lemma/POS/dep/head, heads as places; a * after the part of speech marks a nominalisation."""
    out = []
    for i, token in enumerate(text.split()):
        word, lemma, pos, dep, head = token.split("/")
        out.append((i, word, lemma, pos.rstrip("*"), dep, int(head), pos.endswith("*")))
    return out


S = {
    "binds": "PROTEIN0/PROTEIN0/PROPN/nsubj/1 binds/bind/VERB/root/-1 PROTEIN1/PROTEIN1/PROPN/obj/1",
    "present": "PROTEIN0/PROTEIN0/PROPN/nsubj/2 is/be/AUX/cop/2 present/present/ADJ/root/-1",
    "passive": "PROTEIN0/PROTEIN0/PROPN/nsubj:pass/2 is/be/AUX/aux/2 activated/activate/VERB/root/-1 by/by/ADP/case/4 PROTEIN1/PROTEIN1/PROPN/obl/2 and/and/CCONJ/cc/6 PROTEIN2/PROTEIN2/PROPN/conj/4",
    "negated": "PROTEIN0/PROTEIN0/PROPN/nsubj/3 does/do/AUX/aux/3 not/not/PART/advmod/3 bind/bind/VERB/root/-1 PROTEIN1/PROTEIN1/PROPN/obj/3",
    "uncertain": "PROTEIN0/PROTEIN0/PROPN/nsubj/2 may/may/AUX/aux/2 bind/bind/VERB/root/-1 PROTEIN1/PROTEIN1/PROPN/obj/2",
    "nominal": "inhibition/inhibition/NOUN*/nsubj/5 of/of/ADP/case/2 PROTEIN0/PROTEIN0/PROPN/nmod/0 by/by/ADP/case/4 PROTEIN1/PROTEIN1/PROPN/nmod/0 occurs/occur/VERB/root/-1",
    "complex": "PROTEIN0/PROTEIN0/PROPN/compound/2 PROTEIN1/PROTEIN1/PROPN/compound/2 complex/complex/NOUN/root/-1",
    "alias": "PROTEIN0/PROTEIN0/PROPN/root/-1 ,/,/PUNCT/punct/2 PROTEIN1/PROTEIN1/PROPN/appos/0",
    "conj": "PROTEIN0/PROTEIN0/PROPN/nsubj/1 binds/bind/VERB/root/-1 PROTEIN1/PROTEIN1/PROPN/obj/1 and/and/CCONJ/cc/4 activates/activate/VERB/conj/1 PROTEIN2/PROTEIN2/PROPN/obj/4",
    "reciprocal": "PROTEIN0/PROTEIN0/PROPN/nsubj/3 and/and/CCONJ/cc/2 PROTEIN1/PROTEIN1/PROPN/conj/0 interact/interact/VERB/root/-1",
    "aligned": "PROTEIN0/PROTEIN0/PROPN/nsubj/3 and/and/CCONJ/cc/2 PROTEIN1/PROTEIN1/PROPN/conj/0 bind/bind/VERB/root/-1 PROTEIN2/PROTEIN2/PROPN/obj/3 and/and/CCONJ/cc/6 PROTEIN3/PROTEIN3/PROPN/conj/4 respectively/respectively/ADV/advmod/3",
}
PAIRS = {
    "binds": {(0, 1)}, "present": set(), "passive": {(0, 1), (0, 2)}, "negated": set(), "uncertain": set(), "nominal": {(0, 1)}, "complex": {(0, 1)},
    "alias": set(), "conj": {(0, 1), (0, 2)}, "reciprocal": {(0, 1)}, "aligned": {(0, 2), (1, 3)},
}


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame([*((k, parse(v)) for k, v in S.items()), ("empty", []), ("none", None)], SCHEMA)


def test_pairs(sentences):
    got = {k: set() for k in S}
    for r in E.predicted_pairs(E.extract_events(sentences)).collect():
        got[r.sentence_id].add((r.a, r.b))
    assert got == PAIRS


def test_events(sentences):
    rows = {}
    for r in E.with_pairs(E.extract_events(sentences)).collect():
        rows.setdefault(r.sentence_id, []).append(r)
    (passive,) = rows["passive"]
    assert (passive.sources, passive.targets, passive.construction, passive.reason) == ([1, 2], [0], "passive", "directed")
    assert rows["negated"][0].reason == rows["uncertain"][0].reason == "not_asserted" and rows["negated"][0].assertion_status == "negated"
    assert rows["alias"][0].event_type == "RELATION_STATEMENT" and rows["alias"][0].reason == "relational"
    assert [e.predicate for e in rows["conj"]] == ["bind", "activate"] and "empty" not in rows


def test_paths(spark, sentences):
    pairs = spark.createDataFrame([("binds", 0, 1), ("conj", 0, 2), ("binds", 0, 7)], "sentence_id string, a int, b int")
    got = {(r.sentence_id, r.b): r for r in E.lexical_paths(sentences, pairs).collect()}
    assert set(got) == {("binds", 1), ("conj", 2)}
    assert (got["binds", 1].apex, got["binds", 1].deps, got["binds", 1].hops) == ("bind", "nsubj obj", 2)
    assert got["conj", 2].lemmas == "PROTEIN0 bind activate PROTEIN2" and got["conj", 2].deps == "nsubj conj obj"


def test_aliases_and_markers(spark):
    df = spark.createDataFrame([("s", ["Ab c", "x", "ABC"], "PROTEIN2 and PROTEIN0, PROTEIN2")], "sentence_id string, proteins array<string>, t string")
    assert [tuple(r) for r in E.self_alias_pairs(df).collect()] == [("s", 0, 2)]
    assert df.select(E.marker_numbers(F.col("t"))).first()[0] == [0, 2]
