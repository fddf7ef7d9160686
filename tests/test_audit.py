from accordant.operators import audit as A

ROWS = "trigger string, chain string, evidence string, pattern int, form string, trigger_type string, key string, total long, gold_positive long, gold_negative long, mention_observations long, event_occurrences long, agreement double"


def row(trigger, chain, evidence, pattern, form, total=0, positive=0, given=0.0, events=None):
    return (trigger, chain, evidence, pattern, form, "verbal", f"{form}{pattern}", total, positive, total - positive, None, events, given)


def test_given_agreement_stays_where_the_first_pattern_is_alone(spark):
    rows = [
        row("a", "c", "candidate_pattern_ledger", 2, "verbal", 10, 4, 0.8),  # four of five labelled
        row("a", "d", "structural", 1, "verbal", 10, 5, 0.5), row("a", "d", "candidate_pattern_ledger", 2, "verbal", 10, 4, 0.8),
        row("a", "e", "candidate_pattern_ledger", 2, "verbal", 10, 4, 0.8), row("a", "e", "candidate_pattern_ledger", 3, "nominal", 10, 0, 0.0),
    ]
    chains = A.consolidated_chains(spark.createDataFrame(rows, ROWS))
    got = {r.chain: ({s.evidence: s.agreement for s in r.by_evidence}, r.headline.evidence, {s.form: s.agreement for s in r.observed if s.evidence != "structural"}) for r in chains.collect()}
    assert got["c"] == ({"candidate_pattern_ledger": 0.8}, "candidate_pattern_ledger", {"verbal": 0.8})
    assert got["d"] == ({"structural": 0.5, "candidate_pattern_ledger": 0.4}, "structural", {"verbal": 0.4})
    assert got["e"] == ({"candidate_pattern_ledger": 0.2}, "candidate_pattern_ledger", {"verbal": 0.8, "nominal": 0.0})


def test_triggers_in_reading_order(spark):
    rows = [
        row("big", "c1", "structural", 1, "verbal", 9, 3), row("small", "c2", "structural", 1, "verbal", 2, 2), row("said", "c3", "relational_statement", 1, "x", 50, 1), row("", "c4", "structural", 1, "verbal", 99, 9),
        row("only", "c5", "event_without_final_pair", 1, "x", events=7), row("also", "c5", "lexicalized_path", 1, "x", 3, 1), row(None, "c6", "structural", 1, "verbal", 1, 0), row("big", "c7", "event_without_final_pair", 1, "x", events=4),
    ]
    out = A.trigger_list(A.consolidated_chains(spark.createDataFrame(rows, ROWS))).collect()
    assert [r.trigger for r in out] == ["big", "small", A.NO_TRIGGER, "said", "also", "only"]
    assert out[0].headline.total == 9 and out[0].patterns == 2 and [s.event_occurrences for s in out[0].by_evidence] == [4, 0] and out[2].headline.total == 100
    assert [r.chain for r in A.pattern_list(A.consolidated_chains(spark.createDataFrame(rows, ROWS))).filter("trigger = 'big'").collect()] == ["c1", "c7"]
    assert A.trigger_list(A.consolidated_chains(spark.createDataFrame([], ROWS))).count() == 0


def test_examples_and_realizations(spark):
    evidence = spark.createDataFrame([row("a", "c", "structural", 1, "verbal", 5, 1), row("a", "c", "structural", 1, "nominal", 7, 1), row("a", "c", "lexicalized_path", 9, "verbal", 99, 1)], ROWS)
    few = spark.createDataFrame([("a", "c", p, o, s, "0-1", "gold") for p, o, s in ((9, 1, "s1"), (1, 2, "s2"), (1, 1, "s3"), (9, 2, "s2"), (9, 3, "s4"))], "trigger string, chain string, pattern int, ordinal int, sentence_id string, pair string, status string")
    assert [e.sentence_id for e in A.consolidated_chains(evidence, few).first().examples] == ["s3", "s2", "s1"]
    assert [(r.pattern, r.form) for r in A.realizations(evidence).orderBy("place").collect()] == [(1, "nominal"), (1, "verbal"), (9, "verbal")]
