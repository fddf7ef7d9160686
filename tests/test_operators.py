import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import agreement, cells, evidence, graphs, matching, models, paths, reliability, resample
from accordant.sources import corpora, sinks

# (dimension, key, corpus, positive, negative)
CELLS = [("p", "a", "x", 2, 5), ("p", "a", "y", 8, 4), ("p", "b", "x", 5, 24), ("p", "b", "y", 26, 19), ("p", "c", "x", 1, 1)]


@pytest.fixture
def few(spark):
    return spark.createDataFrame([(*c, c[3] + c[4]) for c in CELLS], "dimension string, key string, corpus string, gold_positive long, gold_negative long, support long")


def test_published_tests(few):
    rows = {r.key: r for r in agreement.pairwise_tests(few, ["dimension", "key"], ["dimension"]).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].p_value, rows["b"].p_value) == (0.169802, 0.000678022)
    assert (rows["a"].cpr_delta_abs, rows["b"].cpr_delta_abs) == (pytest.approx(0.380953), pytest.approx(0.405364))
    assert rows["b"].q_value == pytest.approx(2 * 0.000678022) and rows["a"].q_value == pytest.approx(0.169802)


def test_unlabelled_rows_drop_or_count_as_negative(spark):
    df = spark.createDataFrame([("k", "positive"), ("k", "unlabeled"), ("k", None), (None, "positive")], "key string, gold_label string")
    assert tuple(cells.cell_counts(df, ["key"]).first()) == ("k", 1, 1, 0)
    assert tuple(cells.cell_counts(df, ["key"], unlabelled="negative").first()) == ("k", 3, 1, 2)
    with pytest.raises(ValueError):
        cells.cell_counts(df, ["key"], unlabelled="keep")
    assert cells.cell_counts(df.filter(F.lit(False)), ["key"]).count() == 0


def test_consistency(few):
    kinds = {(r.key, r.corpus): r.kind for r in cells.with_consistency(few).collect()}
    assert kinds == {("a", "x"): "split", ("a", "y"): "split", ("b", "x"): "isolated", ("b", "y"): "split", ("c", "x"): "split"}


def test_heterogeneity_of_one_partition_is_none(few):
    rows = {r.key: r for r in reliability.heterogeneity(few, ["key"]).collect()}
    assert (rows["c"].q, rows["c"].df, rows["c"].i_squared, rows["c"].heterogeneous) == (0.0, 0, 0.0, False)
    assert rows["b"].heterogeneous and rows["b"].q == pytest.approx(74 * (5 * 19 - 26 * 24) ** 2 / (29 * 45 * 31 * 43))


def test_sentence_labels(spark):
    rows = [([1], [1]), ([1, 2], [1]), ([1], [1, 2]), ([3], [1]), ([], []), ([1], None)]
    df = spark.createDataFrame(rows, "p array<int>, g array<int>")
    assert [r[0] for r in df.select(reliability.sentence_label(F.col("p"), F.col("g"))).collect()] == ["correct", "too_many", "too_few", "wrong_pairs", "correct", "no_gold"]


def test_overlap_groups_and_as_of(spark):
    df = spark.createDataFrame([("k", 0, 2), ("k", 1, 5), ("k", 4, 6), ("k", 6, 7), ("k", 0, 9)][:4], "k string, s int, e int")
    assert [r.group for r in evidence.overlap_groups(df, ["k"], "s", "e").orderBy("s").collect()] == [0, 0, 0, 1]
    out = evidence.preceding(df, ["k"], ["s"], F.col("e") > 2, "s", "last").orderBy("s").collect()
    assert [r.last for r in out] == [None, None, 1, 4]


def test_pairs(spark):
    df = spark.createDataFrame([(0,), (1,), (3,)], "n int")
    assert [[tuple(p) for p in r[0]] for r in df.select(evidence.all_pairs(F.col("n"))).collect()] == [[], [], [(0, 1), (0, 2), (1, 2)]]


def test_tree_path_and_rendering(spark):
    df = spark.createDataFrame([(1, [1, -1, 1, 2], ["a", "is", "c", "d"]), (2, [-1, -1], ["x", "y"]), (3, [1, 0], ["p", "q"])], "id int, h array<int>, w array<string>")
    up = df.select("id", graphs.ancestors(F.col("h"), F.lit(0)).alias("a"), graphs.ancestors(F.col("h"), F.size("h") - 1).alias("b"))
    got = {r.id: r.p for r in up.select("id", graphs.tree_path(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got[1] == [0, 1, 2, 3] and got[2] == []
    trees = {r.id: r.tree for r in graphs.render_tree(df, "id", "w", "h").collect()}
    assert trees[1] == "is\n  a\n  c\n    d" and trees[2] == "x\ny" and trees[3] == ""


def test_identity_closure_and_spans(spark):
    df = spark.createDataFrame([(5, [(0, 3), (3, 4)]), (2, [])], "n int, e array<struct<a:int,b:int>>")
    assert [r[0] for r in df.select(graphs.identity_closure(F.col("n"), F.col("e"))).collect()] == [[0, 1, 2, 0, 0], [0, 1]]
    nodes = spark.createDataFrame([([(0, 3), (4, 6), (7, 9)],)], "n array<struct<char_start:int,char_end:int>>")
    row = nodes.select(graphs.nodes_in_span(F.col("n"), F.lit(5), F.lit(7)).alias("s"), graphs.nearest_before(F.col("n"), F.lit(6)).alias("b")).first()
    assert [tuple(x) for x in row.s] == [(4, 6)] and tuple(row.b) == (4, 6)


def test_shuffles_keep_sizes_and_repeat(spark):
    rows = [(s, c, 10 + c, (3 * c) % 7) for s in "ab" for c in range(5)]
    df = spark.createDataFrame(rows, "s string, c int, support long, gold_positive long")
    total = sum(r[3] for r in rows)
    assert {r.value for r in resample.shuffled_labels(df, ["s"], lambda p, n: float(p.sum()), 60, 1).collect()} == {float(total)}
    one, two = (sorted(r.value for r in resample.gap_null(df, ["s"], 40, 7).collect()) for _ in range(2))
    assert one == two and len(set(one)) > 5
    row = resample.null_summary(resample.gap_null(df, ["s"], 40, 7), -1.0).first()
    assert row.p_value == 1.0 and row.replicates == 40


def test_cluster_bootstrap_of_one_cluster_is_the_value(spark):
    rows = [("s", p, "d" + p, 10, k) for p, k in (("x", 3), ("y", 8))]
    df = spark.createDataFrame(rows, "s string, p string, d string, support long, gold_positive long")
    assert {round(r.value, 9) for r in resample.cluster_bootstrap(df, ["s"], "p", "d", 20, 3).collect()} == {0.5}


def test_ridge_logit_is_a_minimum():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(200, 3)), rng.integers(1, 4, 200).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.5]))).astype(float)
    for c in (0.1, 1.0, 100.0):
        beta = models.ridge_logit(x, y, w, c)
        full = np.column_stack([x, np.ones(200)])
        gradient = np.append(beta[:3], 0) + c * full.T @ (w * (1 / (1 + np.exp(-full @ beta)) - y))
        assert np.abs(gradient).max() < 1e-6


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([("g", 0.1, 0, 1), ("g", 0.5, 1, 1), ("g", 0.5, 0, 1), ("g", 0.9, 1, 2), ("h", 0.1, 1, 1)], "g string, s double, y int, w long")
    got = {r.g: r.auc for r in models.auc(df, ["g"], "s", "y", "w").collect()}
    assert got == {"g": pytest.approx((1.5 + 4) / 6), "h": None}


def test_out_of_fold_with_a_base_rate(spark):
    rows = [(f, c, "a", int(i < k)) for f in range(2) for c, k in (("x", 18), ("y", 4)) for i in range(20)]
    df = spark.createDataFrame([*rows, (1, "z", "a", 1)], "fold int, corpus string, cue string, y int")
    plain = {(r.fold, r.corpus): r.p for r in models.out_of_fold(df, ["cue"], "y", carry=("corpus",)).collect()}
    rate = {(r.fold, r.corpus): r.p for r in models.out_of_fold(df, ["cue"], "y", carry=("corpus",), rate="corpus").collect()}
    assert plain[0, "x"] == plain[0, "y"] and rate[0, "x"] > rate[0, "y"]
    # A corpus that the training fold lacks has the share of all, here midway between the others.
    assert rate[1, "y"] < rate[1, "z"] < rate[1, "x"] and len(plain) == len(rate) == 5


def test_within_auc_and_fold_summary(spark):
    df = spark.createDataFrame([("g", "x", 0.9, 1, 1), ("g", "x", 0.1, 0, 1), ("g", "y", 0.2, 1, 2), ("g", "y", 0.3, 0, 2), ("g", "z", 0.5, 1, 9)], "g string, c string, s double, y int, w long")
    assert models.within_auc(df, ["g"], "c", "s", "y", "w").first().auc_within == pytest.approx(2 / 6)
    folds = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "m string, v double")
    got = {r.m: tuple(r)[1:] for r in models.fold_summary(folds, "v", ("m",)).collect()}
    assert got["a"] == pytest.approx((2.0, 1.0, 0.04, 3.96, 2)) and got["b"] == pytest.approx((2.0, 0.0, 2.0, 2.0, 1))


def test_lift_within_and_by_partition(spark):
    # In x the other score sorts all, base none; in y both sort all; z has one class.
    rows = [("x", "d1", 0.5, 0.9, 1), ("x", "d1", 0.5, 0.1, 0), ("y", "d2", 0.9, 0.9, 1), ("y", "d2", 0.1, 0.1, 0), ("z", "d3", 0.9, 0.9, 1)]
    df = spark.createDataFrame(rows, "c string, d string, a double, b double, y int")
    got = {}
    for r in models.auc_lift_bootstrap(df, "d", "c", "a", "b", "y", 7, 1).collect():
        got.setdefault(r.scope, []).append(r.value)
    assert {k: (len(v), set(v)) for k, v in got.items() if k != "raw"} == {"within": (7, {0.25}), "in x": (7, {0.5}), "in y": (7, {0.0})}
    assert len(got["raw"]) == 7 and got["raw"][0] == pytest.approx(1 - 5.5 / 6)


def test_text_model_counts_words_over_the_training_folds(spark):
    # leak stands in the held-out fold alone; counted over all rows it would displace a word of the training folds.
    rows = [(0, ["good"] if i % 2 else ["bad"], i % 2) for i in range(20)] + [(1, ["leak", "good"] if i % 2 else ["leak", "bad"], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "fold int, words array<string>, y int")
    held = models.text_model(df, "words", "y", "fold", [], most=2).filter("fold = 1").collect()
    assert len(held) == 20 and all((r.p > 0.6) == (r.y == 1) for r in held) and len({round(r.p, 6) for r in held}) == 2


def test_balanced_folds(spark):
    df = spark.createDataFrame([(d,) for d, n in (("a", 5), ("b", 3), ("c", 2), ("d", 1)) for _ in range(n)], "d string")
    assert {r.d: r.fold for r in models.folds_by_size(df, "d", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_matched_gaps(spark):
    rows = [("s", "x", 1)] * 5 + [("s", "y", 0)] * 5 + [("t", "x", 1)] * 5 + [("t", "y", 1)] * 4
    rates = matching.stratum_rates(spark.createDataFrame(rows, "s string, c string, y int"), ["s"], "c", "y")
    assert [tuple(r) for r in matching.stratum_gaps(rates, ["s"]).collect()] == [("s", 2, 10, 1.0)]


def test_prepositions(spark):
    df = spark.createDataFrame([(["Of", "between", "among", None],)], "p array<string>")
    assert df.select(paths.preposition_signature(F.col("p"))).first()[0] == "_+between/among+of"


# ---- readers and writers ----------------------------------------------------------------------

ENTRY = {"sentence": "PROTEIN0 binds PROTEIN1.", "orig_sentence": "A binds B.", "proteins": ["A", "B"], "relations": {"[1, 0]": "PPI", "[0, 0]": "PPI", "x": "PPI", "[0, 5]": "MISSING_LABEL_1"}}


def test_corpus_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"n": 1}, "data": {"s1": ENTRY}}))
    (tmp_path / "b.json").write_text(json.dumps({"s2": ENTRY | {"sentence": "", "text": "PROTEIN0 is present."}}))
    rows = {r.sentence_id: r for r in corpora.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"s1", "s2"} and rows["s2"].sentence == "PROTEIN0 is present."
    df = corpora.read_corpus(spark, str(tmp_path))
    pairs = {r.sentence_id: [tuple(p) for p in r.p] for r in df.select("sentence_id", corpora.gold_pairs(F.col("relations")).alias("p")).collect()}
    assert pairs["s1"] == [(0, 0), (0, 1)]
    assert {r.sentence_id: (r.missing, r.extra, [tuple(p) for p in r.beyond]) for r in corpora.mask_problems(df).collect()} == {"s1": ([], [], [(0, 5)]), "s2": ([1], [], [(0, 5)])}
    assert tuple(corpora.metadata(df).first()) == (2, 2, 2, 8)


def test_prediction_problems(spark, tmp_path):
    lines = [{"id": "1", "text": "PROTEIN0 x"}, {"id": "1", "text": "PROTEIN0 y"}, {"id": " ", "text": "PROTEIN0"}, {"id": "2", "text": ""}, {"id": "3", "sentence": "no protein"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = sorted((r.sentence_id, r.problem) for r in corpora.prediction_problems(corpora.read_predictions(spark, str(tmp_path))).collect())
    assert got == [("", "no id"), ("1", "repeated id"), ("2", "no text"), ("3", "no marker")]


def test_masking():
    e = lambda i, t, o: {"_id": i, "_text": t, "_charOffset": o}
    x = lambda a, b, t="PPI": {"_e1": a, "_e2": b, "_type": t}
    text, proteins, relations = corpora.masked("xAB binds C.", [e("c", "C", "10-11"), e("ab", "AB", "1-3"), e("b", "B", "2-3")], [x("c", "ab"), x("b", "b"), x("ab", "c", "T")])
    assert text == "x PROTEIN0 PROTEIN1 binds PROTEIN2." and proteins == ["AB", "B", "C"] and relations == {"[0, 2]": "T"}
    # alpha (0-5) and beta share "chain": the first has another within its gap, so it goes at its first span.
    text, proteins, _ = corpora.masked("alpha beta chain", [e("1", "alpha chain", "0-5,11-16"), e("2", "beta", "6-10")], [])
    assert text == "PROTEIN0 PROTEIN1 chain" and proteins == ["alpha chain", "beta"]
    with pytest.raises(ValueError):
        corpora.masked("a", [], [x("1", "2")])
    for bad in ("", "5-3", "x"):
        with pytest.raises(ValueError):
            corpora.offsets(bad)


def test_source_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("""<corpus><document id="d"><sentence id="d.s0" text="A hits B"><entity id="e0" text="A" charOffset="0-1"/><entity id="e1" text="B" charOffset="7-8"/>
      <interaction e1="e0" e2="e1" type="PPI"/></sentence><sentence id="d.s1" text="None here"></sentence></document></corpus>""")
    rows = {r.sentence_id: r for r in corpora.mask_sentences(corpora.read_sentence_xml(spark, str(tmp_path / "c.xml"))).collect()}
    assert rows["d.s0"].sentence == "PROTEIN0 hits PROTEIN1" and rows["d.s0"].relations == {"[0, 1]": "PPI"}
    assert rows["d.s1"].sentence == "None here" and rows["d.s1"].proteins == []


def test_ledgers_and_stores(spark, tmp_path):
    df = spark.createDataFrame([("c", "m", ["b", "a"])], "corpus string, metric string, v array<string>")
    sinks.write_ledger(df.withColumnRenamed("v", "value"), str(tmp_path / "l"), ["corpus", "metric", "value"], one_file=True)
    assert [tuple(r) for r in corpora.read_ledger(spark, str(tmp_path / "l"), "corpus_summary").collect()] == [("c", "m", "b|a")]
    assert corpora.read_ledger(spark, str(tmp_path / "none"), "corpus_summary").count() == 0
    old, new = spark.createDataFrame([(1, "a", 0)], "k int, v string, o int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 3)], "k int, v string, o int")
    assert sorted(tuple(r)[:2] for r in sinks.insert_or_replace(old, new, ["k"], "o").collect()) == [(1, "c"), (2, "d")]
    assert sorted(tuple(r)[:2] for r in sinks.insert_or_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "d")]
    sinks.write_store({"t": old}, str(tmp_path / "s"))
    assert sinks.open_store(spark, str(tmp_path / "s"), ["t"])["t"].count() == spark.sql("SELECT * FROM t").count() == 1
    assert [tuple(r) for r in sinks.summary_rows({"t": new}, "x").collect()] == [("x", "t", "3")]
    (tmp_path / "w.txt").write_text("# list\nOne\n\n two \n")
    assert sorted(r.word for r in corpora.read_lexicon(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]
    assert corpora.with_columns_or(old, {"v": "z", "w": "z"}).first().w == "z"
