from accordant.operators import traces as X

PAIR = "array<struct<a:int,b:int>>"


def build(spark, pred, gold, parser_ok=True, events=(), proposals=(), plans=()):
    sentences = spark.createDataFrame([("s", pred, gold, parser_ok)], f"sentence_id string, pred_pairs {PAIR}, gold_pairs {PAIR}, parser_ok boolean")
    events = spark.createDataFrame([("s", *e) for e in events], "sentence_id string, event_id string, entities array<int>")
    proposals = spark.createDataFrame([("s", *p) for p in proposals], "sentence_id string, candidate_id string, pair_a int, pair_b int, assertion_status string, projection_mode string, source_event_id string")
    plans = spark.createDataFrame([("s", *p) for p in plans], "sentence_id string, id string, source_event_id string, application_status string, reason_code string")
    return {(r.a, r.b): r for r in X.build_traces(sentences, events, proposals, plans).collect()}


def test_stages(spark):
    got = build(spark, [(2, 1), (3, 3), (0, 1)], [(1, 2), (7, 8), (1, 9)], events=[("e1", [1, 2]), ("e2", [2, 5]), (None, [6])], proposals=[("c", 4, 5, "negated", "structural", None), ("d", 1, 5, None, "relational", "e2"), ("f", 1, 5, "asserted", "relational", "e2")])
    assert {k: (r.stage, r.endpoint_visibility, r.gold_status) for k, r in got.items()} == {
        (1, 2): (X.EMITTED, "same_event_no_pair", "positive"),
        (0, 1): (X.DISAGREES, "one_endpoint", "negative"),
        (7, 8): (X.NO_EVENT, "neither_endpoint", "positive"),
        (1, 9): (X.NOT_BOUND, "one_endpoint", "positive"),
        (2, 5): (X.NOT_PROPOSED, "same_event_no_pair", "negative"),
        (4, 5): (X.SUPPRESSED, "pair_candidate_exists", "negative"),
        (1, 5): (X.REVIEW, "pair_candidate_exists", "negative"),
    }
    assert got[1, 5].proposal_refs == ["d", "f"] and got[1, 5].event_refs == ["e1", "e2"] and got[1, 5].assertion_statuses == ["asserted"]
    assert got[4, 5].application_status == "blocked_assertion" and got[2, 5].application_status == "not_generated"


def test_reasons_need_all_plans_to_have_failed(spark):
    one = lambda *plans: build(spark, [], [], events=[("e", [1])], proposals=[("c", 1, 2, "asserted", "structural", "x")], plans=plans)[1, 2]
    r = one(("p1", "e", "not_applied", "no role"), ("p2", "x", "not_applied", "no role"), ("p3", "y", "applied", ""))
    assert (r.application_status, r.reason_code, r.projection_plan_refs, r.reasons, r.reason_observed) == ("not_applied", "no role", ["p1", "p2"], ["no role"], True)
    assert one(("p1", "e", "not_applied", "b"), ("p2", "x", "not_applied", "a")).reason_code == X.MANY_REASONS
    for plans in ([("p1", "e", "not_applied", "b"), ("p2", "x", "applied", "a")], [("p1", "e", "not_applied", None)], [("p1", "e", None, "b")], []):
        r = one(*plans)
        assert (r.application_status, r.reason_code, r.reason_observed) == ("not_applied_reason_unobserved", X.NOT_APPLIED, False)


def test_without_a_release_and_without_a_parse(spark):
    got = build(spark, [(1, 2)], None, parser_ok=False)
    assert got[1, 2].stage == X.EMITTED and got[1, 2].gold_status == "unlabeled"
    assert build(spark, [], [(1, 2)], parser_ok=False)[1, 2].stage == X.UNUSABLE
    assert build(spark, None, None) == {}


def test_tables_dealt_by_sentence_are_shuffled_once(spark):
    """What follows the pairs takes the tables as they lie: the plan of the rest has no exchange."""
    from accordant.scratch import co_located, dealt

    pairs = spark.createDataFrame([(f"s{k}", [(1, 2)], [(1, 3)], True) for k in range(20)], f"sentence_id string, pred_pairs {PAIR}, gold_pairs {PAIR}, parser_ok boolean")
    events = spark.createDataFrame([(f"s{k}", "e", [1, 3]) for k in range(20)], "sentence_id string, event_id string, entities array<int>")
    proposals = spark.createDataFrame([(f"s{k}", "c", 1, 3, "", "structural", "e") for k in range(20)], "sentence_id string, candidate_id string, pair_a int, pair_b int, assertion_status string, projection_mode string, source_event_id string")
    plans = spark.createDataFrame([(f"s{k}", "p", "e", "not_applied", "why") for k in range(20)], "sentence_id string, id string, source_event_id string, application_status string, reason_code string")
    with co_located(spark):
        df = X.build_traces(*(dealt(t, "t", "sentence_id") if t is not proposals else t for t in (pairs, events, proposals, plans)))
        rows = {(r.a, r.b, r.stage, r.reason_code) for r in df.collect()}
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows == {(1, 2, X.DISAGREES, X.DISAGREES), (1, 3, X.NOT_APPLIED, "why")} and df.count() == 40


def odd_store(spark):
    """Null and blank texts, ends that are negative or of any size, repeated ids and rows, a sentence without an id, rows of sentences that aren't there."""
    least, most = -(2**31), 2**31 - 1
    sentences = spark.createDataFrame(
        [("s", [(2, 1), (1, 2), (3, 3)], [(1, 2), (least, most)], True), ("t", None, None, None), ("u", [], [], False), ("v", [(-1, -5)], None, True), (None, [(1, 2)], [], True)],
        f"sentence_id string, pred_pairs {PAIR}, gold_pairs {PAIR}, parser_ok boolean",
    )
    events = spark.createDataFrame([("s", "e1", [1, 2, 2, None]), ("s", "e1", [least, 7]), ("s", None, [7, 1]), ("t", "e2", None), ("t", "e3", [-4, 4]), ("gone", "e4", [1, 2]), (None, "e5", [1, 2])], "sentence_id string, event_id string, entities array<int>")
    candidates = spark.createDataFrame(
        [("s", "c", 2, 1, "", "structural", "e9", "go", "clause", "k1"), ("s", "c", 1, 2, None, None, None, " ", None, "k2"), ("s", None, 1, 7, "asserted", "relational", "e1", "go", "", None), ("s", "d", 7, 1, "negated", "structural", "", "be", "state", ""), ("t", "x", 4, -4, "asserted", "structural", "e8", "do", "clause", "k1"),
         ("t", "y", None, 1, "", "", "", "", "", ""), ("gone", "z", 1, 2, "", "", "", "", "", ""), ("v", "w", -5, -1, "  ", "held", "e", None, "clause", "k3")],
        "sentence_id string, candidate_id string, pair_a int, pair_b int, assertion_status string, projection_mode string, source_event_id string, predicate_lemma string, realization_channel string, canonical_pattern_key string",
    )
    plans = spark.createDataFrame([("s", "p1", "e1", "not_applied", "why"), ("s", None, "e1", None, None), ("t", "p2", "e8", "not_applied", "a"), ("t", "p2", "e3", "not_applied", "b"), ("t", "p3", "", "applied", "c"), ("s", "p4", "e9", "applied", None)], "sentence_id string, id string, source_event_id string, application_status string, reason_code string")
    return sentences, events, candidates, plans


def test_a_ledger_with_its_traces_is_that_of_stored_traces(spark):
    from pyspark.sql import functions as F

    from accordant.operators import ledgers as L

    sentences, events, candidates, plans = odd_store(spark)
    names = ("stage", "endpoint_visibility", "application_status", "reason_code", "proposal_refs", "event_refs", "projection_plan_refs", "assertion_statuses", "projection_modes")
    rows = X.build_traces(sentences, events, candidates, plans)
    stored = rows.groupBy("sentence_id").agg(F.collect_list(F.struct(F.struct("a", "b").alias("pair"), *names)).alias("traces"))
    want = L.pair_ledger(sentences.filter("sentence_id IS NOT NULL").join(stored, "sentence_id"), candidates, "x").collect()
    got = L.traced_ledger(sentences, events, candidates, plans, "x").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 6
    found = {(r.sentence_id, r.pair_a, r.pair_b): r for r in got}
    r = found["s", 1, 2]
    assert (r.stage, r.proposal_count, r.proposal_refs, r.event_refs, r.projection_plan_refs, r.trigger_lemmas, r.pattern_keys, r.gold_label) == (X.EMITTED, 2, "c", "e1", "p1|p4", "go", "k1|k2", "positive")
    assert found["s", -(2**31), 2**31 - 1].gold_label == "positive" and found["s", 1, 7].assertion_statuses == "asserted|negated" and found["v", -5, -1].stage == X.EMITTED
    assert (found["t", -4, 4].reason_code, found["t", -4, 4].projection_plan_refs) == (X.MANY_REASONS, "p2")


def test_tables_are_grouped_by_sentence_in_one_pass(spark):
    """No step groups or joins by pair, and sorted rows are grouped without partial results."""
    from accordant.scratch import co_located, dealt

    with co_located(spark, one_pass=True):
        df = X.build_traces(*(dealt(t, "t", "sentence_id") for t in odd_store(spark)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" not in plan and "ObjectHash" not in plan and plan.count("SortMergeJoin [sentence_id#") == plan.count("SortMergeJoin") == 3
        assert df.count() == 6
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg") == "false"
