"""Review tables: what is gathered for them."""

from accordant.operators import review as R


def test_only_the_reports_sentences_are_gathered(spark):
    sentences = spark.createDataFrame([("s1", "no_event"), ("s2", "too_few"), ("s3", "too_few"), ("s4", "correct")], "sentence_id string, label string")
    events = spark.createDataFrame([(s, f"k{s}", "d") for s in ("s1", "s2", "s3", "s4")] + [("s1", "k0", "d")], "sentence_id string, pattern_key string, event_detail string")
    out = R.missing_sentences(sentences, events, limit=2)
    assert [(r.sentence_id, r.pattern_keys, r.event_details) for r in out.collect()] == [("s1", "k0,ks1", "d"), ("s2", "ks2", "d")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GlobalLimit") == 2  # for the report's rows and for the events that are asked


def test_statements_are_joined_once(spark, sf):
    """What the counts, statuses and examples read was written before: none of them goes back to the line items."""
    from accordant.plans import store

    assert "lineitem" not in store.statements(spark, sf)._jdf.queryExecution().toString()
