import json

import pytest
from pyspark.sql import functions as F

from accordant import entry
from accordant.functions import text as X
from accordant.operators import codebook as B
from accordant.operators import events as E
from accordant.operators import ledgers as L
from accordant.operators import signatures as G
from accordant.plans import lexical, store
from accordant.sources import runs

from .oracle import assert_same


def test_registry_and_stats_dir(spark, tmp_path):
    assert runs.dataset_path({"One": "/d/one/"}, "ONE", "test") == "/d/one/test.json"
    with pytest.raises(ValueError, match="known: one"):
        runs.dataset_path({"One": "/d/one/"}, "two", "test")
    with pytest.raises(ValueError, match="split"):
        runs.dataset_path({"One": "/d/one/"}, "one", "dev")
    (tmp_path / "analysis" / "stats").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        runs.stats_dir(spark, str(tmp_path))
    (tmp_path / "analysis" / "stats" / "corpus_summary.csv").write_text("corpus,metric,value\n")
    assert runs.stats_dir(spark, str(tmp_path)) == f"{tmp_path}/analysis/stats"


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    assert [tuple(r) for r in runs.read_json_lines(spark, f"{tmp_path}/x.jsonl", "a int, b string").collect()] == [(1, "x"), (2, None)]
    assert runs.read_json_lines(spark, f"{tmp_path}/none.jsonl", "a int, b string").count() == 0


def test_audit_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 2), ("y", 9), ("a", 2)], "signature string, n int")
    runs.write_audit(df, f"{tmp_path}/audit", "n", "signature")
    assert [r.signature for r in runs.read_audit(spark, f"{tmp_path}/audit", "signature string, n int", "n", "signature").collect()] == ["y", "a", "x"]


def test_run_and_identity(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text("x\n")
    one = runs.run_identity("m", "d", "full", "ab", {"x": 1, "y": 2}, {"p": "1"})
    assert one["fingerprint"] == runs.run_identity("m", "d", "full", "ab", {"y": 2, "x": 1}, {"p": "1"})["fingerprint"]
    assert one["fingerprint"] != runs.run_identity("m", "d", "full", "ab", {"x": 2, "y": 2}, {"p": "1"})["fingerprint"]
    assert runs.write_run(spark, str(tmp_path), one, {"ledger.csv": True, "other.csv": False})["status"] == "complete"
    manifest = runs.write_run(spark, str(tmp_path), one, {"ledger.csv": True, "gone.csv": True}, {"sentences": 3})
    assert manifest["missing_required"] == ["gone.csv"] and json.loads((tmp_path / "run.json").read_text())["status"] == "incomplete"
    assert json.loads((tmp_path / "workflow_stats.json").read_text()) == {"sentences": 3}


def test_parsed_cache(spark, tmp_path):
    df = spark.createDataFrame([("s1", [1, 2], None), ("s2", [], "x")], "sentence_id string, heads array<int>, note string")
    path = f"{tmp_path}/cache"
    assert runs.load_parsed(spark, path, "sha", {"p": 1}, "c") is None
    runs.write_parsed(df.repartition(2), path, "sha", {"p": 1}, "c")
    assert runs.load_parsed(spark, path, "sha", {"p": 1}, "c").count() == 2
    assert runs.stale(spark, path, "other", {"p": 2}, "c") == ["source_sha256", "parser"]
    df.limit(1).write.parquet(f"{path}/records", mode="overwrite")
    assert runs.stale(spark, path, "sha", {"p": 1}, "c") == ["records_sha256", "record_count"]
    (tmp_path / "cache" / "manifest.json").write_text("{")
    (tmp_path / "cache" / ".manifest.json.crc").unlink(missing_ok=True)
    assert runs.stale(spark, path, "sha", {"p": 1}, "c") == ["manifest_unreadable"]


def test_six_ledgers(spark, sf, tmp_path):
    s, c, a, e = (f(spark, sf) for f in (store.sentences, store.candidates, store.attributions, store.events))
    lexical = L.lexical_ledger(a, "demo")
    made = {"pair_observations": L.pair_ledger(s, c, "demo"), "pattern_observations": L.pattern_ledger(s, c, "demo"), "lexical_observations": lexical, "carrier_trigger_observations": L.carrier_ledger(lexical), "event_observations": L.event_ledger(e, "demo")}
    with pytest.raises(ValueError, match="corpus_summary"):
        runs.write_ledgers(made, f"{tmp_path}/l", "demo")
    runs.write_ledgers(made | {"corpus_summary": L.corpus_summary("demo", s, {})}, f"{tmp_path}/l", "demo")
    back = spark.read.csv(f"{tmp_path}/l/pattern_observations.csv", header=True)
    assert back.count() == c.count() and back.columns == made["pattern_observations"].columns and "corpus_summary" in runs.read_text(spark, f"{tmp_path}/l/README.md")


def test_older_stores_lack_columns(spark):
    s = spark.createDataFrame([("s1", [(1, 0)], None)], "sentence_id string, pred_pairs array<struct<a:int,b:int>>, gold_pairs array<struct<a:int,b:int>>")
    c = spark.createDataFrame([("s1", 0, 1), ("s1", 2, 2)], "sentence_id string, pair_a int, pair_b int")
    (r,) = L.pair_ledger(s, c, "x").collect()
    assert (r.pair_a, r.pair_b, r.gold_label, r.predicted_label, r.stage, r.proposal_count) == (0, 1, "unlabeled", "positive", "emitted", 1)
    rows = L.pattern_ledger(s, c, "x").orderBy("pair_a").collect()
    assert rows[0].pair_a is None and rows[0].gold_label is None and rows[1].canonical_pattern_key == "" and rows[1].is_nominalized == 0


def test_event_rows(spark):
    span = "struct<text:string,lemmas:array<string>,pos:string>"
    schema = f"sentence_id string, sentence string, tokens array<int>, token_offsets array<struct<start:int,end:int>>, arguments map<string,array<struct<text:string>>>, event struct<event_type:string,relation_subtype:string,construction:string,is_directed:boolean,predicate:{span},case_markers:array<{span}>>"
    rows = [
        ("s1", "P0 binds to P1.", [1, 3], [(0, 2), (3, 8), (9, 11), (12, 14)], {"targets": [("P1",)]}, ("EVENT", None, "verbal", True, ("binds", ["Bind"], "VERB"), [("to", ["to"], "ADP")])),
        ("s2", "P0 binds P1", [0, 2], None, {}, ("RELATION_STATEMENT", "IS-A", "", None, ("Interaction", [], "NOUN"), [])),
        ("s3", "x", [], None, {}, ("EVENT", None, "", False, None, [])),
        ("s4", "x", [0], None, {}, ("RELATION_STATEMENT", "", None, None, None, [])),
    ]
    got = {r.sentence_id: r for r in E.event_rows(spark.createDataFrame(rows, schema), G.nominal_map({"interaction": "interact"})).collect()}
    assert (got["s1"].span, got["s1"].span_min, got["s1"].span_max, got["s1"].pattern_key) == ("binds to P1", 1, 3, "structural|AB|bind|to|verbal") and json.loads(got["s1"].arguments_json) == {"targets": [{"text": "P1"}]}
    assert (got["s2"].span, got["s2"].pattern_key, got["s2"].semantic_pattern_key) == ("P0 binds P1", "relational|RELATIONAL|interact|_|nominalized", "relational|RELATIONAL|interact|_|nominalized")
    assert got["s3"].span is None and got["s3"].pattern_key is None and got["s3"].arguments_json is None
    assert got["s4"].pattern_key == "relational|RELATIONAL|relational|_|verbal" and got["s1"].semantic_pattern_key == "structural|bind"


def test_groups_are_useful_or_not(spark):
    rows = [("a", 1, '{"x": [{"group": {"members": ["p", "q"]}}]}'), ("a", 2, '{"x": [{"group": {"members": ["p"]}}]}'), ("b", 1, '{"x": [{"group": {"all_protein_indices": [1]}}], "y": []}'), ("b", 2, '{"x": []}'), ("c", 1, "broken \"group\"")]
    events = spark.createDataFrame(rows, "sentence_id string, event_id int, arguments_json string")
    got = E.semantic_evidence(events, spark.createDataFrame([("a",), ("b",), ("c",)], "sentence_id string"))
    assert [(r.sentence_id, r.event_id) for r in got.collect()] == [("a", 1), ("b", 1)]
    assert E.semantic_evidence(events, spark.createDataFrame([("a",), ("b",)], "sentence_id string"), 1).count() == 1


def test_codebook_and_spans(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"process_layer": ["Binding "], "role_entity_carrier": ["receptor"]}))
    book = B.read_codebook(spark, f"{tmp_path}/book.json")
    assert book == {"role_entity_carrier": ["receptor"], "process_layer": ["binding"]}
    rows = spark.createDataFrame([("receptor+binding",), ("a-b",), (None,), ("zzz",)], "s string").select(B.signature_classes(F.col("s"), book).alias("c"), B.effect_guess(F.col("s"), book).alias("g")).collect()
    assert [(list(r.c), r.g) for r in rows] == [(["role_entity_carrier", "process_layer"], "entity_boundary"), (["other_carrier"], "tokenization_artifact"), (["none"], "none"), (["other_carrier"], "unknown")]
    with pytest.raises(ValueError, match="unknown classes"):
        (tmp_path / "bad.json").write_text('{"odd": []}')
        B.read_codebook(spark, f"{tmp_path}/bad.json")
    assert X.canonical_json({"b": 1, "a": [2, None]}) == '{"a":[2,null],"b":1}' and len(X.fingerprint([1], 12)) == 12


def test_corpora_that_are_none_and_listed_pairs(spark, tmp_path):
    from accordant.sources import corpora

    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception, match="no corpus object"):
        corpora.read_corpus(spark, f"{tmp_path}/bad.json").collect()
    rows = spark.createDataFrame([('[{"protein_a": 2, "protein_b": 1}, {"arg1": 0, "arg2": 3}, {"x": 1}]',), ("[[3, 0], [0, 3], [1], [-1, 2]]",), ("nothing",)], "r string")
    got = [[tuple(p) for p in r.p] if r.p is not None else None for r in rows.select(corpora.listed_pairs(F.col("r")).alias("p")).collect()]
    assert got == [[(0, 3), (1, 2)], [(0, 3)], None]


def test_last_split_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "id string, v int")
    assert sorted(tuple(r) for r in E.last_split_wins([a, b], "id").collect()) == [("x", 1), ("y", 3), ("z", 4)]


def test_classes_of_rows_at_one_place(spark, sf, tmp_path):
    """Line items of one place in the input are one observation, with the classes of all their signatures."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    twins = items.filter("l_partkey > 31 AND l_orderkey % 3 = 0").withColumns({"l_partkey": F.col("l_partkey") - 31, "l_suppkey": F.col("l_suppkey") + 1009})  # place: 1009 * 31 - 31 * 1009
    items.unionByName(twins).coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    assert_same(lexical.classes(spark, str(tmp_path)), entry.oracle_sql()["T29_codebook_classes"], str(tmp_path))
