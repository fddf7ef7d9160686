"""Queries over an event store and its ledgers, each with the SQL it is held against.

The store is made of the driver's tables: an order is a sentence, a line item a proposed relation, an event and an attribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledgers as L
from ..operators import review as R
from ..operators import traces as X
from ..scratch import by_sentence
from .fixtures import read

_KEY = "concat('structural|', case l_linenumber % 3 when 0 then 'AB' when 1 then 'AA' else 'RELATIONAL' end, '|verb', cast(l_partkey % 12 as string), '|_|verbal')"

#: name -> the same expression for both engines.
_CANDIDATES = {
    "id": "cast(l_orderkey as bigint) * 8000000 + l_linenumber * 1000000 + (l_partkey * 1009 + l_suppkey * 31) % 1000000",
    "sentence_id": "concat('s', cast(l_orderkey as string))",
    "candidate_id": "concat('c', cast(l_orderkey as string), '.', cast(l_linenumber as string))",
    "pair_a": "case when l_partkey % 17 = 0 then null else cast(l_partkey % 5 as int) end",
    "pair_b": "cast(l_suppkey % 4 as int)",
    "schema": "case when l_partkey % 2 = 0 then 'is-a' else '' end",
    "source_event_id": "case when l_linenumber % 2 = 0 then cast(l_linenumber as string) else null end",
    "predicate_lemma": "case when l_partkey % 13 = 0 then 'is-a' else concat('verb', cast(l_partkey % 12 as string)) end",
    "event_detail": "concat('detail', cast(l_suppkey % 6 as string))",
    "realization_channel": "case l_linenumber % 3 when 0 then 'clause' when 1 then 'event_nominal' else '' end",
    "assertion_status": "case when l_quantity < 5 then 'negated' when l_quantity < 20 then '' else 'Asserted' end",
    "projection_mode": "case when l_linenumber % 4 = 3 then 'Relational' else 'structural' end",
    "ambiguity_reason": "case when l_partkey % 19 = 0 then 'two readings' else ' ' end",
    "decision": "case l_linenumber when 1 then 'applied' when 2 then 'review_only' else '' end",
    "shape": "case l_linenumber % 3 when 0 then 'AB' when 1 then 'AA' else 'RELATIONAL' end",
    "construction": "case when l_linestatus = 'O' then 'verbal' else 'nominal' end",
    "case_marker": "case when l_partkey % 3 = 0 then 'of' else '' end",
    "owner_propagated": "case when l_suppkey % 2 = 0 then 1 else 0 end",
    "compound_propagated": "case when l_suppkey % 3 = 0 then 1 else 0 end",
    "descriptor_propagated": "case when l_suppkey % 5 = 0 then 1 else 0 end",
    "canonical_pattern_key": f"case when l_partkey % 11 = 0 then null else {_KEY} end",
    "payload": "concat('{\"pattern_key\": \"k', cast(l_partkey % 3 as string), '\", \"semantic_pattern_key\": \"m', cast(l_partkey % 4 as string), '\", \"application_status\": \"', case when l_tax > 0.04 then 'held' else 'applied' end, '\", \"decision\": \"from payload\"}')",
}
_EVENTS = {
    "sentence_id": _CANDIDATES["sentence_id"],
    "event_id": "l_linenumber",
    "event_type": "case when l_linenumber % 3 = 0 then 'RELATION_STATEMENT' else 'Event' end",
    "semantic_event_class": "case when l_linenumber % 3 = 0 then 'relation_statement' else 'predicate_event' end",
    "event_detail": _CANDIDATES["event_detail"],
    "realization_channel": _CANDIDATES["realization_channel"],
    "predicate_lemma": "case when l_partkey % 13 = 0 then '' else concat('verb', cast(l_partkey % 12 as string)) end",
    "pattern_key": _KEY,
    "pred_pairs": "case when l_quantity > 25 then concat('[[', cast(l_partkey % 5 as string), ', ', cast(l_suppkey % 4 as string), ']]') else '[]' end",
    "arguments_json": "case when l_partkey % 7 = 0 then '{}' else concat('{\"entities_a\": {\"targets\": [', cast(l_partkey % 5 as string), '], \"owners\": [{\"protein_indices\": [', cast(l_suppkey % 4 as string), ', 9]}]}, \"core', cast(l_partkey % 2 as string), '\": {}}') end",
}
_ATTRIBUTIONS = {
    "sentence_id": _CANDIDATES["sentence_id"],
    "term": "concat('word', cast(l_partkey % 23 as string))",
    "category": "case l_linenumber % 3 when 0 then 'target_context' when 1 then 'trigger_verbal' else 'trigger_nominal' end",
    "role": "case when l_suppkey % 3 = 0 then 'owner_of_a' when l_suppkey % 3 = 1 then 'descriptor' else null end",
    "pattern_key": _KEY,
    "is_evaluable": "case when l_tax > 0.06 then 0 else 1 end",
    "is_correct": "case when l_discount > 0.05 then 1 else 0 end",
    "gives_pairs": "case when l_quantity > 25 then 1 else 0 end",
}
_LABEL = "case cast(o_custkey % 7 as int) when 0 then 'too_many' when 1 then 'wrong_pairs' when 2 then 'too_few' when 3 then 'no_event' when 4 then 'no_gold' else 'correct' end"


def _table(spark: SparkSession, sf: str, columns: dict[str, str]) -> DataFrame:
    return read(spark, sf, "lineitem").select(*(F.expr(x).alias(n) for n, x in columns.items()))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, _CANDIDATES)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, _EVENTS)


def attributions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, _ATTRIBUTIONS)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences' ids, texts and labels, without their pairs."""
    key = F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sentence_id")
    return read(spark, sf, "orders").select(key, F.concat(F.lit("text of "), F.col("o_orderkey").cast("string")).alias("text"), F.expr(_LABEL).alias("label"))


def sentences(spark: SparkSession, sf: str, in_order: bool = False) -> DataFrame:
    """Predicted pairs are those of large items, released ones those of discounted items; orders in process have none released."""
    pair = F.struct((F.col("l_partkey") % 5).cast("int").alias("a"), (F.col("l_suppkey") % 4).cast("int").alias("b"))
    key = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("sentence_id")
    # By sentence from the start: what groups or joins the sentences further finds them so.
    marked = read(spark, sf, "lineitem").select(key("l_orderkey"), F.when(F.col("l_quantity") > 25, pair).alias("pred"), F.when(F.col("l_discount") > 0.05, pair).alias("gold")).repartition("sentence_id")
    marked = marked.sortWithinPartitions("sentence_id") if in_order else marked
    given = marked.groupBy("sentence_id").agg(F.collect_set("pred").alias("pred_pairs"), F.collect_set("gold").alias("_gold"))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    rows = read(spark, sf, "orders").select(key("o_orderkey"), "o_orderkey", "o_custkey", "o_orderstatus").join(given, "sentence_id", "left")
    gold = F.when(F.col("o_orderstatus") != "P", F.coalesce("_gold", empty))
    trace = F.struct(
        F.struct(F.lit(3).alias("a"), F.lit(1).alias("b")).alias("pair"), F.lit("held").alias("stage"), F.lit("both").alias("endpoint_visibility"), F.lit(None).cast("string").alias("application_status"), F.lit("no rule").alias("reason_code"),
        F.array(F.lit("p2"), F.lit("p1"), F.lit("p2")).alias("proposal_refs"), F.array(F.lit("e1")).alias("event_refs"), F.lit(None).cast("array<string>").alias("projection_plan_refs"), F.array(F.lit("traced")).alias("assertion_statuses"), F.array().cast("array<string>").alias("projection_modes"),
    )
    traces = F.when(F.col("o_custkey") % 5 == 0, F.array(trace))
    return rows.select(
        "sentence_id", F.concat(F.lit("text of "), F.col("o_orderkey").cast("string")).alias("text"), F.expr(_LABEL).alias("label"),
        F.coalesce("pred_pairs", empty).alias("pred_pairs"), gold.alias("gold_pairs"), traces.alias("traces"),
    )


_PLANS = {
    "sentence_id": _CANDIDATES["sentence_id"],
    "id": "concat('p', cast(l_orderkey as string), '.', cast(l_linenumber % 3 as string))",
    "source_event_id": "case when l_partkey % 23 = 0 then null else cast(l_linenumber as string) end",
    "application_status": "case when l_tax > 0.07 then 'applied' when l_tax > 0.005 then 'not_applied' else null end",
    "reason_code": "case l_suppkey % 3 when 0 then 'role_missing' when 1 then 'not_directed' else null end",
}


def plans(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, _PLANS)


_ENTITIES = "struct<entities_a:struct<targets:array<int>,owners:array<struct<protein_indices:array<int>>>>>"


def _spread(df: DataFrame) -> DataFrame:
    """By sentence, in as many partitions as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sentence_id")


def _traceable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sentences without the traces that the store gives some, events, candidates and plans, each shuffled by sentence once; that of an order in ten had no usable parse."""
    rows = sentences(spark, sf, in_order=True).drop("traces").withColumn("parser_ok", ~F.col("sentence_id").endswith("7"))
    made = events(spark, sf).select("sentence_id", "event_id", F.from_json("arguments_json", _ENTITIES)["entities_a"].alias("args"))  # parsed once for both of its uses
    shown = X.visible_entities(F.lit(None).cast("array<int>"), F.array("args.targets"), F.transform("args.owners", lambda o: o["protein_indices"]))
    return rows, _spread(made.select("sentence_id", "event_id", shown.alias("entities"))), _spread(candidates(spark, sf)), _spread(plans(spark, sf))


@by_sentence(one_pass=True)
def trace_rows(spark: SparkSession, sf: str) -> DataFrame:
    lists = ("proposal_refs", "event_refs", "projection_plan_refs", "assertion_statuses", "projection_modes", "reasons")
    return X.build_traces(*_traceable(spark, sf)).withColumns({n: F.array_join(n, "|") for n in lists})


@by_sentence(one_pass=True)
def traced_pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The pair ledger over the traces that were made, by stage, visibility and reason."""
    ledger = L.traced_ledger(*_traceable(spark, sf), "demo")
    return ledger.groupBy("stage", "endpoint_visibility", "application_status", "reason_code", "gold_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("proposal_count").alias("proposals"), F.max("event_refs").alias("events"), F.max("projection_plan_refs").alias("plans"), F.max("trigger_lemmas").alias("lemmas")
    )


def _cte(name: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in columns.items()).replace("as string", "as varchar") + " FROM lineitem)"


_STORE = ", ".join([
    _cte("candidates", _CANDIDATES),
    _cte("event_rows", _EVENTS),
    _cte("attributions", _ATTRIBUTIONS),
    f"""sentences AS (SELECT 's' || o_orderkey AS sentence_id, o_orderkey, o_custkey, 'text of ' || o_orderkey AS text, {_LABEL} AS label, o_orderstatus <> 'P' AS released FROM orders)""",
    """given AS (SELECT DISTINCT 's' || l_orderkey AS sentence_id, (l_partkey % 5)::INT AS x, (l_suppkey % 4)::INT AS y, l_quantity > 25 AS pred, l_discount > 0.05 AS gold FROM lineitem)""",
    "pred AS (SELECT DISTINCT sentence_id, least(x, y) AS a, greatest(x, y) AS b FROM given WHERE pred)",
    "gold AS (SELECT DISTINCT g.sentence_id, least(x, y) AS a, greatest(x, y) AS b FROM given g JOIN sentences s ON s.sentence_id = g.sentence_id AND released WHERE gold)",
    "cands AS (SELECT *, CASE WHEN pair_a IS NOT NULL THEN least(pair_a, pair_b) END AS a, CASE WHEN pair_a IS NOT NULL THEN greatest(pair_a, pair_b) END AS b FROM candidates)",
])


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([_STORE, *ctes])} {body}"


def sql_over(body: str) -> str:
    """A query over the store's tables and plans."""
    return _sql(body, _cte("plans", _PLANS))


@by_sentence(one_pass=True)
def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.pair_ledger(sentences(spark, sf, in_order=True), candidates(spark, sf), "demo")


def pattern_rows(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["sentence_id", "candidate_id", "pair_a", "pair_b", "gold_label", "predicted_label", "application_status", "decision", "canonical_pattern_key", "semantic_pattern_key", "predicate_lemma", "shape", "case_marker", "source_role", "owner_propagated", "is_nominalized"]
    rows = L.pattern_ledger(sentences(spark, sf), candidates(spark, sf), "demo").select(keep)
    return rows.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("pair_a", "pair_b")})


def lexical_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.lexical_ledger(attributions(spark, sf), "demo")


def carrier_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.carrier_ledger(lexical_rows(spark, sf))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.event_ledger(events(spark, sf), "demo").select("sentence_id", "event_id", "event_type", "predicate_lemma", "relation_type", "is_inferred", "pred_pair_count", "argument_roles")


def summary(spark: SparkSession, sf: str) -> DataFrame:
    named = {"events": L.event_ledger(events(spark, sf), "demo"), "pair_observations": pair_rows(spark, sf), "pattern_observations": pattern_rows(spark, sf), "lexical_observations": lexical_rows(spark, sf)}
    return L.corpus_summary("demo", sentences(spark, sf), named)


def candidate_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return L.candidate_patterns(sentences(spark, sf), candidates(spark, sf))


def population(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.residual_population(L.pattern_ledger(sentences(spark, sf), candidates(spark, sf), "demo"), carrier_rows(spark, sf), cap=5)
    return rows.groupBy("doc", "predicate_lemma", "case_marker", "carrier_words", "carrier_roles", "source_role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


def extra_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return R.extra_sentences(_labelled(spark, sf), events(spark, sf)).select("sentence_id", "text", "label", "pattern_keys", "event_details")


def missing_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return R.missing_sentences(_labelled(spark, sf), events(spark, sf)).select("sentence_id", "text", "label", "pattern_keys", "event_details")


def statements(spark: SparkSession, sf: str) -> DataFrame:
    trigger = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("noun"), F.substr("predicate_lemma", F.lit(5)))).otherwise("")
    return R.relational_statements(sentences(spark, sf), candidates(spark, sf), _distinct_events(spark, sf), trigger)


def _distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    """One event a sentence and number: that of the least description."""
    return events(spark, sf).groupBy("sentence_id", "event_id").agg(F.min(F.struct("event_detail", "predicate_lemma", "event_type", "semantic_event_class")).alias("e")).select("sentence_id", "event_id", "e.*")


def bare_events(spark: SparkSession, sf: str) -> DataFrame:
    return R.events_without_pairs(sentences(spark, sf), events(spark, sf)).drop("examples")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return R.pattern_examples(sentences(spark, sf), candidates(spark, sf))


def pattern_store(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences' pairs as observations of each of their candidates' patterns."""
    rows = candidates(spark, sf).select("sentence_id", F.col("id").alias("seq"), F.col("predicate_lemma").alias("word"), F.col("case_marker").alias("preposition"), F.col("shape").alias("yield_type"), F.col("construction"), F.concat(F.lit("x"), F.col("id") % 5).alias("example"))
    return R.pattern_store(rows.join(sentences(spark, sf).select("sentence_id", "pred_pairs", "gold_pairs"), "sentence_id"))


def merged_patterns(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).filter("canonical_pattern_key IS NOT NULL").select(
        F.col("canonical_pattern_key").alias("pattern_key"), F.lit("m").alias("semantic_pattern_key"), F.col("predicate_lemma").alias("lemma"), F.col("case_marker").alias("preposition"), F.lit("AB").alias("yield_type"), "shape",
        F.lit("structural").alias("evidence_class"), "construction", F.lit("enabled").alias("review_status"), F.lit("default").alias("source"), (F.col("id") % 2).alias("correct"), F.lit(1).alias("total"), "id",
    )
    return R.merged_patterns(rows, "id").select("pattern_key", "lemma", "preposition", "construction", "correct", "total", "precision")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return R.word_reliability(R.word_stats(attributions(spark, sf)), min_count=3)


def type_precision(spark: SparkSession, sf: str) -> DataFrame:
    return R.event_type_precision(sentences(spark, sf), events(spark, sf))


def member_pairs(spark: SparkSession, sf: str) -> DataFrame:
    members = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 6).cast("int")).alias("m"))
    return members.select(F.inline(R.same_event_pairs(F.col("m")))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("why", F.when(F.col("decision") == "", F.concat(F.lit("no "), F.col("projection_mode"))))
    return R.reasons(rows, {"proposed": F.lit(True), "paired": F.col("pair_a").isNotNull(), "applied": F.col("decision") == "applied"}, "why")


def relational_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.relational(candidates(spark, sf)).join(sentences(spark, sf).select("sentence_id", "label"), "sentence_id")
    return rows.groupBy("label", "shape").agg(F.count(F.lit(1)).alias("n"))


def _trace_ctes() -> list[str]:
    seen = "list_sort(list(DISTINCT x.event_id::VARCHAR))"
    return [
        _cte("plans", _PLANS),
        """shown AS MATERIALIZED (SELECT DISTINCT sentence_id, event_id, unnest(list_concat((j ->> '$.entities_a.targets')::INT[], list_transform(json_extract(j, '$.entities_a.owners[*].protein_indices[*]'), lambda x: x::INT))) AS entity
            FROM (SELECT sentence_id, event_id, arguments_json::JSON AS j FROM event_rows))""",
        # Events of one number in one sentence are events of their own where they hold pairs.
        """each AS (SELECT sentence_id, r, unnest(list_concat((j ->> '$.entities_a.targets')::INT[], list_transform(json_extract(j, '$.entities_a.owners[*].protein_indices[*]'), lambda x: x::INT))) AS entity
            FROM (SELECT sentence_id, row_number() OVER () AS r, arguments_json::JSON AS j FROM event_rows))""",
        "same AS (SELECT DISTINCT p.sentence_id, p.entity AS a, q.entity AS b FROM each p JOIN each q ON p.r = q.r AND p.entity < q.entity)",
        """props AS (SELECT sentence_id, a, b, list_sort(list(DISTINCT CASE WHEN coalesce(assertion_status, '') = '' THEN 'asserted' ELSE assertion_status END)) AS assertions, list_sort(list(DISTINCT projection_mode) FILTER (projection_mode <> '')) AS modes,
            list_sort(list(candidate_id)) AS ids, list(DISTINCT source_event_id) FILTER (source_event_id <> '') AS sources FROM cands WHERE a < b GROUP BY ALL)""",
        "pairs AS (SELECT sentence_id, a, b FROM pred WHERE a < b UNION SELECT sentence_id, a, b FROM gold WHERE a < b UNION SELECT * FROM same UNION SELECT sentence_id, a, b FROM props)",
        f"""joined AS MATERIALIZED (SELECT u.*, e.x IS NOT NULL AS predicted, g.x IS NOT NULL AS gold, s.x IS NOT NULL AS same, p.ids IS NOT NULL AS proposed, p.assertions, p.modes, p.ids, p.sources, released, NOT ends_with(u.sentence_id, '7') AS ok,
            (SELECT {seen} FROM shown x WHERE x.sentence_id = u.sentence_id AND x.entity = u.a) AS at_a, (SELECT {seen} FROM shown x WHERE x.sentence_id = u.sentence_id AND x.entity = u.b) AS at_b FROM pairs u
            LEFT JOIN (SELECT *, 1 AS x FROM pred) e USING (sentence_id, a, b) LEFT JOIN (SELECT *, 1 AS x FROM gold) g USING (sentence_id, a, b) LEFT JOIN (SELECT *, 1 AS x FROM same) s USING (sentence_id, a, b) LEFT JOIN props p USING (sentence_id, a, b) JOIN sentences USING (sentence_id))""",
        """staged AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat(coalesce(at_a, []), coalesce(at_b, [])))) AS refs, CASE WHEN predicted THEN CASE WHEN gold OR NOT released THEN 'emitted' ELSE 'emitted_gold_disagreement' END
            WHEN proposed THEN CASE WHEN NOT list_contains(assertions, 'asserted') THEN 'assertion_suppressed' WHEN len(list_filter(coalesce(modes, []), lambda m: m <> 'relational')) = 0 THEN 'relational_review_only' ELSE 'proposal_not_applied' END
            WHEN same THEN 'pair_not_proposed' WHEN at_a IS NOT NULL OR at_b IS NOT NULL THEN 'argument_not_bound' WHEN ok THEN 'event_not_found' ELSE 'parser_unusable' END AS stage,
            CASE WHEN proposed THEN 'pair_candidate_exists' WHEN same THEN 'same_event_no_pair' WHEN at_a IS NOT NULL AND at_b IS NOT NULL THEN 'separate_events' WHEN at_a IS NOT NULL OR at_b IS NOT NULL THEN 'one_endpoint' ELSE 'neither_endpoint' END AS endpoint_visibility FROM joined)""",
        """told AS (SELECT s.sentence_id, s.a, s.b, list_sort(list(DISTINCT p.id)) AS plan_ids, list_distinct(list(coalesce(p.application_status, ''))) AS statuses, list_sort(list(DISTINCT p.reason_code) FILTER (p.reason_code <> '')) AS reasons FROM staged s JOIN plans p
            ON p.sentence_id = s.sentence_id AND (list_contains(s.refs, p.source_event_id) OR list_contains(s.sources, p.source_event_id)) GROUP BY ALL)""",
        """traced AS MATERIALIZED (SELECT *, coalesce(stage = 'proposal_not_applied' AND statuses = ['not_applied'] AND len(reasons) > 0, false) AS failed FROM staged LEFT JOIN told USING (sentence_id, a, b))""",
        """trace_rows AS (SELECT sentence_id, a, b, stage, endpoint_visibility, CASE WHEN failed THEN 'not_applied' WHEN predicted THEN 'applied' WHEN stage = 'assertion_suppressed' THEN 'blocked_assertion' WHEN stage = 'relational_review_only' THEN 'review_only' WHEN proposed THEN 'not_applied_reason_unobserved' ELSE 'not_generated' END AS application_status,
            CASE WHEN NOT released THEN 'unlabeled' WHEN gold THEN 'positive' ELSE 'negative' END AS gold_status, predicted AS emitted, coalesce(array_to_string(ids, '|'), '') AS proposal_refs, array_to_string(refs, '|') AS event_refs, coalesce(array_to_string(plan_ids, '|'), '') AS projection_plan_refs,
            coalesce(array_to_string(assertions, '|'), '') AS assertion_statuses, coalesce(array_to_string(modes, '|'), '') AS projection_modes, CASE WHEN NOT failed THEN stage WHEN len(reasons) = 1 THEN reasons[1] ELSE 'multiple_application_reasons' END AS reason_code,
            failed OR predicted OR stage IN ('assertion_suppressed', 'relational_review_only') AS reason_observed, CASE WHEN failed THEN array_to_string(reasons, '|') ELSE '' END AS reasons FROM traced)""",
    ]


def catalogue() -> dict[str, tuple]:
    unique = lambda c, extra="": f"coalesce(string_agg(DISTINCT {c}, '|' ORDER BY {c}) FILTER ({c} <> ''), '')"
    label = "CASE WHEN NOT released THEN 'unlabeled' WHEN g.a IS NOT NULL THEN 'positive' ELSE 'negative' END"
    index = f"""cx AS (SELECT sentence_id, a, b, count(*) AS n, {unique("k")} AS pattern_keys, {unique("predicate_lemma")} AS trigger_lemmas, {unique("realization_channel")} AS channels, {unique("projection_mode")} AS modes,
        list(DISTINCT assertion_status) AS statuses FROM (SELECT *, coalesce(nullif(canonical_pattern_key, ''), json_extract_string(payload, '$.pattern_key'), '') AS k FROM cands WHERE a <> b) GROUP BY ALL)"""
    universe = """uni AS (SELECT sentence_id, 3 AS b, 1 AS a, true AS traced FROM sentences WHERE o_custkey % 5 = 0
        UNION ALL SELECT DISTINCT u.sentence_id, u.b, u.a, false FROM (SELECT sentence_id, a, b FROM pred UNION SELECT sentence_id, a, b FROM gold UNION SELECT sentence_id, a, b FROM cx) u JOIN sentences s ON s.sentence_id = u.sentence_id AND o_custkey % 5 <> 0 WHERE u.a <> u.b)"""
    pair_sql = f"""SELECT 'demo' AS corpus, u.sentence_id, u.a AS pair_a, u.b AS pair_b, {label} AS gold_label, CASE WHEN p.a IS NULL THEN 'negative' ELSE 'positive' END AS predicted_label,
        CASE WHEN traced THEN 'held' WHEN p.a IS NULL THEN 'not_traced' ELSE 'emitted' END AS stage, CASE WHEN traced THEN 'both' ELSE '' END AS endpoint_visibility, CASE WHEN NOT traced AND p.a IS NOT NULL THEN 'applied' ELSE '' END AS application_status,
        CASE WHEN traced THEN 'no rule' ELSE '' END AS reason_code, coalesce(n, 0) AS proposal_count, coalesce(pattern_keys, '') AS pattern_keys, coalesce(trigger_lemmas, '') AS trigger_lemmas, coalesce(channels, '') AS realization_channels,
        array_to_string(list_sort(list_filter(list_distinct(list_concat(CASE WHEN traced THEN ['traced'] ELSE [] END, coalesce(statuses, []))), lambda x: x <> '')), '|') AS assertion_statuses, coalesce(modes, '') AS projection_modes,
        CASE WHEN traced THEN 'p1|p2' ELSE '' END AS proposal_refs, CASE WHEN traced THEN 'e1' ELSE '' END AS event_refs, '' AS projection_plan_refs
        FROM uni u JOIN sentences s USING (sentence_id) LEFT JOIN pred p ON p.sentence_id = u.sentence_id AND p.a = u.a AND p.b = u.b LEFT JOIN gold g ON g.sentence_id = u.sentence_id AND g.a = u.a AND g.b = u.b
        LEFT JOIN cx ON cx.sentence_id = u.sentence_id AND cx.a = u.a AND cx.b = u.b"""
    firing = f"""fired AS (SELECT c.*, CASE WHEN c.a <> c.b THEN {label} END AS gold_label, CASE WHEN c.a <> c.b THEN CASE WHEN p.a IS NULL THEN 'negative' ELSE 'positive' END END AS predicted_label FROM cands c JOIN sentences s USING (sentence_id)
        LEFT JOIN pred p ON p.sentence_id = c.sentence_id AND p.a = c.a AND p.b = c.b LEFT JOIN gold g ON g.sentence_id = c.sentence_id AND g.a = c.a AND g.b = c.b)"""
    pattern_sql = """SELECT sentence_id, candidate_id, CASE WHEN a <> b THEN a::VARCHAR ELSE '' END AS pair_a, CASE WHEN a <> b THEN b::VARCHAR ELSE '' END AS pair_b, gold_label, predicted_label, json_extract_string(payload, '$.application_status') AS application_status, CASE WHEN decision = '' THEN 'from payload' ELSE decision END AS decision,
        coalesce(canonical_pattern_key, json_extract_string(payload, '$.pattern_key')) AS canonical_pattern_key, json_extract_string(payload, '$.semantic_pattern_key') AS semantic_pattern_key, predicate_lemma, shape, case_marker, '' AS source_role, owner_propagated, 0 AS is_nominalized FROM fired"""
    lexical = "lexical AS (SELECT 'demo' AS corpus, sentence_id, term, category, coalesce(role, '') AS role, pattern_key, '' AS event_detail, is_evaluable, is_correct AS gold_positive, CASE WHEN is_evaluable = 0 THEN 'unlabeled' WHEN is_correct = 1 THEN 'positive' ELSE 'negative' END AS gold_label FROM attributions)"
    asserted = """asserted AS (SELECT *, upper(shape) = 'RELATIONAL' OR lower(projection_mode) = 'relational' AS relational FROM fired WHERE lower(CASE WHEN assertion_status = '' THEN 'asserted' ELSE assertion_status END) = 'asserted' AND trim(ambiguity_reason) = '' AND canonical_pattern_key IS NOT NULL)"""
    reviewed = "(SELECT s.sentence_id, text, label, string_agg(DISTINCT pattern_key, ',' ORDER BY pattern_key) AS pattern_keys, string_agg(DISTINCT event_detail, ',' ORDER BY event_detail) AS event_details FROM sentences s LEFT JOIN event_rows e ON e.sentence_id = s.sentence_id GROUP BY ALL)"
    once = "first AS (SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY {1} ORDER BY pair_a, pair_b, id) = 1)"
    carriers = "car AS (SELECT sentence_id, pattern_key, string_agg(DISTINCT term, '+' ORDER BY term) AS w, string_agg(DISTINCT role, '+' ORDER BY role) FILTER (role <> '') AS r FROM lexical WHERE category = 'target_context' GROUP BY ALL)"
    wilson_p, z = "(correct::DOUBLE / total)", 1.96
    half = f"{z} * sqrt({wilson_p} * (1 - {wilson_p}) / total + {z * z} / (4.0 * total * total))"
    mid, scale = f"({wilson_p} + {z * z} / (2.0 * total))", f"(1 + {z * z} / total)"
    return {
        "E25_traces": (trace_rows, _sql("SELECT * FROM trace_rows", *_trace_ctes())),
        "E25_P1_traced_pairs": (traced_pair_rows, _sql("""SELECT stage, endpoint_visibility, application_status, reason_code, gold_status AS gold_label, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS proposals, max(event_refs) AS events, max(projection_plan_refs) AS plans, max(coalesce(lemmas, '')) AS lemmas
            FROM trace_rows LEFT JOIN (SELECT sentence_id, a, b, count(*) AS k, string_agg(DISTINCT predicate_lemma, '|' ORDER BY predicate_lemma) AS lemmas FROM cands WHERE a < b GROUP BY ALL) USING (sentence_id, a, b) GROUP BY ALL""", *_trace_ctes())),
        "P1_J5_pair_ledger": (pair_rows, _sql(pair_sql, index, universe)),
        "P2_J1_pattern_ledger": (pattern_rows, _sql(pattern_sql, firing)),
        "P3_lexical_ledger": (lexical_rows, _sql("FROM lexical", lexical)),
        "P4_carrier_ledger": (carrier_rows, _sql("SELECT corpus, sentence_id, term AS carrier_word, pattern_key, role, is_evaluable, gold_positive, gold_label FROM lexical WHERE category = 'target_context'", lexical)),
        "P5_event_ledger": (event_rows, _sql("""SELECT sentence_id, event_id, event_type, predicate_lemma, '' AS relation_type, 0 AS is_inferred, (pred_pairs <> '[]')::INT AS pred_pair_count,
            coalesce((SELECT string_agg(k, '|' ORDER BY k) FROM (SELECT unnest(json_keys(arguments_json)) AS k)), '') AS argument_roles FROM event_rows""")),
        "P6_corpus_summary": (summary, _sql("""SELECT 'demo' AS corpus, 'sentences' AS metric, (SELECT count(*) FROM sentences) AS value UNION ALL SELECT 'demo', unnest(['events', 'pattern_observations', 'lexical_observations']), count(*) FROM lineitem
            UNION ALL SELECT 'demo', 'pair_observations', count(*) FROM uni UNION ALL SELECT 'demo', 'carrier_trigger_observations', count(*) FROM lexical WHERE category = 'target_context'""", index, universe, lexical)),
        "K1_F8_A12_candidate_patterns": (candidate_patterns, _sql("""SELECT canonical_pattern_key AS pattern_key, arg_min(predicate_lemma, id) AS lemma, nullif(arg_min(case_marker, id), '') AS preposition, arg_min(shape, id) AS shape, CASE WHEN arg_min(relational, id) THEN 'relational' ELSE 'structural' END AS evidence_class,
            arg_min(construction, id) AS construction, CASE WHEN bool_and(relational AND decision <> 'applied') THEN 'review_only_evidence' ELSE 'candidate' END AS review_status, CASE WHEN bool_and(relational AND decision <> 'applied') THEN 'candidate_relation_review' ELSE 'candidate_ledger' END AS source,
            count(*) AS observations, count(DISTINCT CASE WHEN a <> b THEN (sentence_id, a, b) END) AS sentence_pair_observations, count(DISTINCT CASE WHEN gold_label = 'positive' THEN (sentence_id, a, b) END) AS gold_positive_hits, count(DISTINCT CASE WHEN gold_label = 'negative' THEN (sentence_id, a, b) END) AS gold_negative_hits,
            round(coalesce(gold_positive_hits / nullif(gold_positive_hits + gold_negative_hits, 0), 0), 4) AS annotation_agreement FROM asserted GROUP BY 1""", firing, asserted)),
        "S20_population": (population, _sql("""SELECT array_to_string(string_split('demo', '.'), '.') AS doc, CASE WHEN predicate_lemma IN (SELECT predicate_lemma FROM fired WHERE gold_label IN ('positive', 'negative') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) THEN predicate_lemma ELSE 'OTHER' END AS predicate_lemma,
            CASE WHEN case_marker = '' THEN 'na' ELSE case_marker END AS case_marker, coalesce(w, 'none') AS carrier_words, coalesce(r, 'none') AS carrier_roles, 'na' AS source_role, count(*) AS n, count(*) FILTER (gold_label = 'positive') AS y
            FROM fired f LEFT JOIN car ON car.sentence_id = f.sentence_id AND car.pattern_key = coalesce(canonical_pattern_key, json_extract_string(payload, '$.pattern_key')) WHERE gold_label IN ('positive', 'negative') GROUP BY ALL""", firing, lexical, carriers)),
        "F11_J2_extra_sentences": (extra_sentences, _sql(f"SELECT * FROM {reviewed} WHERE label IN ('too_many', 'wrong_pairs') ORDER BY sentence_id LIMIT 500")),
        "O2_missing_sentences": (missing_sentences, _sql(f"SELECT * FROM {reviewed} WHERE label IN ('too_few', 'no_event') ORDER BY label = 'too_few', sentence_id LIMIT 500")),
        "A22_J3_F9_statements": (statements, _sql("""SELECT schema, event_detail, CASE WHEN trigger = '' THEN schema ELSE trigger END AS trigger, CASE WHEN trigger = '' THEN 'relation_schema' ELSE 'relational_nominal' END AS trigger_type, total, gold_positive, total - gold_positive AS gold_negative, round(gold_positive / total, 4) AS agreement_with_gold, assertion_status, examples FROM
            (SELECT sc AS schema, event_detail, trigger, count(*) AS total, count(*) FILTER (hit) AS gold_positive, string_agg(sentence_id, ';' ORDER BY rank) FILTER (rank <= 3) AS examples FROM ranked GROUP BY ALL)
            JOIN (SELECT sc AS schema, event_detail, trigger, string_agg(st || '=' || n, ',' ORDER BY st) AS assertion_status FROM (SELECT sc, event_detail, trigger, st, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY ALL) USING (schema, event_detail, trigger)""",
            "ev AS (SELECT sentence_id, event_id, min((event_detail, predicate_lemma, event_type, semantic_event_class)) AS e FROM event_rows GROUP BY ALL)",
            "nom AS (SELECT sentence_id, event_id, e[1] AS event_detail, 'noun' || substr(e[2], 5) AS t FROM ev WHERE e[4] = 'relation_statement' AND event_id % 2 = 0)",
            "by_detail AS (SELECT sentence_id, event_detail, CASE WHEN min(t) = max(t) THEN min(t) ELSE '' END AS t FROM nom GROUP BY ALL)",
            """rel AS (SELECT c.*, upper(CASE WHEN c.schema = '' THEN 'RELATIONAL' ELSE c.schema END) AS sc, lower(CASE WHEN c.assertion_status = '' THEN 'unknown' ELSE c.assertion_status END) AS st, coalesce(nullif(CASE WHEN predicate_lemma IN ('is-a') THEN '' ELSE predicate_lemma END, ''), nom.t, by_detail.t, '') AS trigger
                FROM cands c LEFT JOIN nom ON nom.sentence_id = c.sentence_id AND nom.event_id::VARCHAR = c.source_event_id LEFT JOIN by_detail ON by_detail.sentence_id = c.sentence_id AND by_detail.event_detail = c.event_detail WHERE (lower(projection_mode) = 'relational' OR shape = 'RELATIONAL') AND c.a IS NOT NULL)""",
            once.format("rel", "sentence_id, sc, event_detail, a, b"),
            "ranked AS (SELECT f.*, g.a IS NOT NULL AS hit, row_number() OVER (PARTITION BY sc, event_detail, trigger ORDER BY f.sentence_id, pair_a, pair_b) AS rank FROM first f LEFT JOIN gold g ON g.sentence_id = f.sentence_id AND g.a = f.a AND g.b = f.b)")),
        "A23_F10_J4_bare_events": (bare_events, _sql("""SELECT CASE WHEN predicate_lemma = '' THEN '(no lexical trigger)' ELSE predicate_lemma END AS trigger, pattern_key, event_detail, CASE WHEN realization_channel = '' THEN 'unknown' ELSE realization_channel END AS realization_channel, count(*) AS event_occurrences
            FROM event_rows JOIN sentences USING (sentence_id) WHERE semantic_event_class = 'predicate_event' AND pred_pairs = '[]' AND arguments_json <> '{}' GROUP BY ALL""")),
        "A24_pattern_examples": (examples, _sql("""SELECT canonical_pattern_key, rank::INT AS rank, f.sentence_id, f.a, f.b, CASE WHEN g.a IS NULL THEN 'gold_negative' ELSE 'gold_positive' END AS status, decision, concat_ws('+', CASE WHEN compound_propagated = 1 THEN 'compound' END, CASE WHEN owner_propagated = 1 THEN 'owner' END, CASE WHEN descriptor_propagated = 1 THEN 'descriptor' END) AS propagation
            FROM (SELECT *, row_number() OVER (PARTITION BY canonical_pattern_key ORDER BY sentence_id, a, b) AS rank FROM first WHERE canonical_pattern_key IS NOT NULL AND a IS NOT NULL) f LEFT JOIN gold g ON g.sentence_id = f.sentence_id AND g.a = f.a AND g.b = f.b WHERE rank <= 3""", once.format("cands", "canonical_pattern_key, sentence_id, a, b"))),
        "A16_pattern_store": (pattern_store, _sql("""SELECT lemma, preposition, yield_type, construction, sum(CASE WHEN released THEN np ELSE 0 END)::BIGINT AS total, sum(CASE WHEN released THEN ng ELSE 0 END)::BIGINT AS correct, round(coalesce(correct / nullif(total, 0), 0), 4) AS precision, any_value(examples) AS examples FROM
            (SELECT predicate_lemma AS lemma, case_marker AS preposition, shape AS yield_type, construction, np, ng, released FROM cands JOIN pg USING (sentence_id)) JOIN
            (SELECT lemma, preposition, yield_type, construction, string_agg('x' || e, ';' ORDER BY rank) FILTER (rank <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY lemma, preposition, yield_type, construction ORDER BY seq, e) AS rank FROM
            (SELECT predicate_lemma AS lemma, case_marker AS preposition, shape AS yield_type, construction, id % 5 AS e, min(id) AS seq FROM cands JOIN pg USING (sentence_id) GROUP BY ALL)) GROUP BY ALL) USING (lemma, preposition, yield_type, construction) GROUP BY ALL""",
            "pg AS (SELECT sentence_id, released, count(DISTINCT p.a * 10 + p.b) AS np, count(DISTINCT CASE WHEN g.a IS NOT NULL THEN p.a * 10 + p.b END) AS ng FROM sentences JOIN pred p USING (sentence_id) LEFT JOIN gold g USING (sentence_id, a, b) GROUP BY ALL)")),
        "A17_merged_patterns": (merged_patterns, _sql("""SELECT canonical_pattern_key AS pattern_key, arg_max(predicate_lemma, id) AS lemma, arg_max(case_marker, id) AS preposition, arg_max(construction, id) AS construction, sum(id % 2)::BIGINT AS correct, count(*) AS total, round(correct / total, 4) AS precision
            FROM candidates WHERE canonical_pattern_key IS NOT NULL GROUP BY 1""")),
        "A8_A18_F13_O1_words": (words, _sql(f"""SELECT *, total - correct AS fp, round(greatest(0, ({mid} - {half}) / {scale}), 4) AS ci_low, round(least(1, ({mid} + {half}) / {scale}), 4) AS ci_high FROM (SELECT term AS word, category, count(*) FILTER (is_evaluable = 1 AND is_correct = 1) AS correct, count(*) FILTER (is_evaluable = 1) AS total,
            count(*) FILTER (is_evaluable = 1 AND is_correct = 0) AS fp_count, count(*) AS count_all, count(*) FILTER (gives_pairs = 1) AS pair_contributing_occurrences, count(*) FILTER (gives_pairs = 0) AS nonprojecting_occurrences, count(*) FILTER (role LIKE '%owner%') AS owner_occurrences,
            count(*) FILTER (role = 'descriptor') AS descriptor_occurrences, 0::BIGINT AS nested_occurrences, round(correct / total, 4) AS precision FROM attributions GROUP BY ALL HAVING count(*) FILTER (is_evaluable = 1) >= 3)""")),
        "A20_type_precision": (type_precision, _sql("""SELECT event_type, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, count(*) AS total, round(tp / total, 4) AS precision FROM (SELECT 'detail' || (l_suppkey % 6) AS event_type,
            EXISTS (FROM given g WHERE g.sentence_id = 's' || l_orderkey AND g.gold AND least(g.x, g.y) = least(l_partkey % 5, l_suppkey % 4) AND greatest(g.x, g.y) = greatest(l_partkey % 5, l_suppkey % 4)) AS hit
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' WHERE l_quantity > 25) GROUP BY 1""")),
        "J10_same_event_pairs": (member_pairs, "WITH m AS (SELECT DISTINCT l_orderkey AS k, (l_partkey % 6)::INT AS v FROM lineitem) SELECT x.v AS a, y.v AS b, count(*) AS n FROM m x JOIN m y ON x.k = y.k AND x.v < y.v GROUP BY ALL"),
        "A46_counters": (counters, _sql("""SELECT 'counter' AS kind, unnest(['proposed', 'paired', 'applied']) AS name, unnest([count(*), count(pair_a), count(*) FILTER (decision = 'applied')]) AS n FROM candidates
            UNION ALL SELECT 'reason', 'no ' || projection_mode, count(*) FROM candidates WHERE decision = '' GROUP BY ALL""")),
        "F9_relational_rows": (relational_rows, _sql("SELECT label, shape, count(*) AS n FROM candidates JOIN sentences USING (sentence_id) WHERE lower(projection_mode) = 'relational' OR shape = 'RELATIONAL' GROUP BY ALL")),
    }
