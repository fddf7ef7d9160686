"""Queries over the pattern audit, with their SQL. The five kinds of evidence are made of the ledger by one text for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from .fixtures import ledger, sql

_POS, _NEG = "sum(case when gold_label = 'positive' then 1 else 0 end)", "sum(case when gold_label = 'negative' then 1 else 0 end)"
_CHAIN = "concat('[A] ', predicate_lemma, ' ', case_marker, ' [B]')"
_EITHER = f"case when {_POS} + {_NEG} = 0 then 0.0 else round({_POS} * 1.0 / ({_POS} + {_NEG}), 4) end"
_SHARE = f"round({_POS} * 1.0 / count(*), 4)"
#: kind -> trigger, chain, pattern, form, trigger type, key, (total, positive, negative, mentions, events), agreement, rows
_KINDS = {
    "structural": ("predicate_lemma", _CHAIN, "1", "construction", "case when construction = 'nominal' then 'nominal' else 'verbal' end", "concat(shape, '|', construction)", ("count(*)", _POS, _NEG, "0", "0"), _SHARE, "evidence_class = 'structural' and pair_a < 5"),
    "candidate_pattern_ledger": ("case when pair_b = 4 then '' else predicate_lemma end", _CHAIN, "2 + pair_b", "construction", "'verbal'", "concat(shape, '|', cast(pair_b as string))", ("count(*)", _POS, _NEG, "count(*) + 1", "0"), _EITHER, "pair_a = 6"),
    "relational_statement": ("predicate_lemma", "concat('[A] IS-A ', predicate_lemma, ' [B]')", "10", "channel", "'relational_nominal'", "channel", ("count(*)", _POS, _NEG, "0", "0"), _SHARE, "evidence_class = 'relational' and predicate_lemma like '%1%'"),
    "lexicalized_path": ("coalesce(carrier_word, '')", "concat('[A] ', coalesce(carrier_word, '-'), ' ', case_marker, ' [B]')", "20", "construction", "'lexical_path'", "concat(construction, '|', shape)", ("count(*)", _POS, _NEG, "0", "0"), _EITHER, "pair_b = 2"),
    "event_without_final_pair": ("case when pair_a = 0 then null else predicate_lemma end", _CHAIN, "30", "channel", "'verbal'", "shape", ("0", "0", "0", "0", "count(*)"), "0.0", "pair_a = pair_b and pair_b > 1"),
}


def _evidence(table: str) -> str:
    parts = []
    for kind, (trigger, chain, pattern, form, type_, key, counts, agreement, rows) in _KINDS.items():
        by = [trigger, chain, pattern, form, type_, key]
        plain = ", ".join(dict.fromkeys(x for x in by if not x.startswith("'") and not x.isdigit()))
        counted = ", ".join(f"cast({c} as bigint) AS {n}" for n, c in zip(A.COUNTS, counts))
        parts.append(f"SELECT {trigger} AS trigger, {chain} AS chain, '{kind}' AS evidence, cast({pattern} as int) AS pattern, {form} AS form, {type_} AS trigger_type, {key} AS key, {counted}, cast({agreement} as double) AS agreement FROM {table} WHERE {rows} GROUP BY {plain}")
    return " UNION ALL ".join(parts)


_EXAMPLES = f"predicate_lemma AS trigger, {_CHAIN} AS chain, cast(1 + pair_b % 2 as int) AS pattern, seq AS ordinal, sentence_id, concat(cast(pair_a as string), '-', cast(pair_b as string)) AS pair, gold_label AS status"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_evidence("{led}"), led=ledger(spark, sf))


def _stats(stats: Column) -> Column:
    return F.array_join(F.transform(stats, _said), ";")


def _said(x: Column) -> Column:
    return F.concat_ws(":", x["evidence"], *(x[n].cast("string") for n in A.COUNTS), F.round(x["agreement"] * 10000).cast("long").cast("string"))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's chains with their statistics as text, and the first examples."""
    out = A.consolidated_chains(evidence(spark, sf), ledger(spark, sf).filter("pair_a > 3").selectExpr(*_select(_EXAMPLES)))
    forms = F.array_join(F.transform("observed", lambda x: F.concat_ws("/", x["form"], _said(x))), ";")
    return out.select("trigger", "chain", F.array_join("trigger_types", "+").alias("trigger_types"), _stats(F.col("by_evidence")).alias("by_evidence"), _said(F.col("headline")).alias("headline"), forms.alias("observed"), F.coalesce(F.array_join(F.transform("examples", lambda x: F.concat_ws("/", x["sentence_id"], x["pair"], x["status"])), ";"), F.lit("")).alias("examples"))


def _select(text: str) -> list[str]:
    """The expressions of a select list; commas within brackets don't part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return out


def triggers(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's triggers, numbered in reading order within their group."""
    out = A.trigger_list(A.consolidated_chains(evidence(spark, sf)))
    return out.select("trigger", "patterns", "reading_group", F.array_join("trigger_types", "+").alias("trigger_types"), _stats(F.col("by_evidence")).alias("by_evidence"), _said(F.col("headline")).alias("headline"))


def realized(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of each chain, by their place."""
    return A.realizations(evidence(spark, sf)).select("trigger", "chain", "place", "pattern", "key", "form", "total")


def catalogue() -> dict[str, tuple]:
    said = "evidence || ':' || " + " || ':' || ".join(A.COUNTS) + " || ':' || round(agreement * 10000)::BIGINT"
    sums = ", ".join(f"sum({n})::BIGINT AS {n}" for n in A.COUNTS)
    ratio = "CASE WHEN total = 0 THEN 0 ELSE round(gold_positive / total, 4) END"
    rank = "list_position([" + ", ".join(f"'{p}'" for p in A.PRIORITY) + "], evidence)"
    ctes = (
        f"raw AS MATERIALIZED (SELECT * REPLACE (coalesce(nullif(trigger, ''), '{A.NO_TRIGGER}') AS trigger) FROM ({_evidence('ledger').replace('as string', 'as varchar')}))",
        "firsts AS (SELECT trigger, chain, min(pattern) AS f FROM raw GROUP BY ALL)",
        f"pats AS (SELECT trigger, chain, evidence, pattern, {sums}, CASE WHEN count(*) = 1 THEN any_value(agreement) ELSE coalesce(round(sum(gold_positive) / nullif(sum(total), 0), 4), 0) END AS agreement FROM raw GROUP BY ALL)",
        f"kinds AS MATERIALIZED (SELECT * EXCLUDE (k, p, g, f), CASE WHEN k = 1 AND p = f THEN g ELSE {ratio} END AS agreement FROM (SELECT trigger, chain, evidence, {sums}, count(*) AS k, min(pattern) AS p, any_value(agreement) AS g FROM pats GROUP BY ALL) JOIN firsts USING (trigger, chain))",
        f"seen AS (SELECT * EXCLUDE (k, p, g, f), CASE WHEN k = 1 AND p = f THEN g ELSE {ratio} END AS agreement FROM (SELECT trigger, chain, evidence, form, {sums}, count(*) AS k, min(pattern) AS p, any_value(agreement) AS g FROM raw GROUP BY ALL) JOIN firsts USING (trigger, chain))",
        f"shown AS (SELECT trigger, chain, string_agg(sentence_id || '/' || pair || '/' || status, ';' ORDER BY rank) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY trigger, chain ORDER BY pattern, ordinal, sentence_id) AS rank FROM (SELECT trigger, chain, sentence_id, pair, min(pattern * 10000000000000 + ordinal) AS at_, arg_min(pattern, pattern * 10000000000000 + ordinal) AS pattern, arg_min(ordinal, pattern * 10000000000000 + ordinal) AS ordinal, arg_min(status, pattern * 10000000000000 + ordinal) AS status FROM (SELECT {_EXAMPLES.replace('as string', 'as varchar')} FROM ledger WHERE pair_a > 3) GROUP BY ALL)) WHERE rank <= {A.EXAMPLES} GROUP BY ALL)",
        "types AS (SELECT trigger, chain, string_agg(DISTINCT trigger_type, '+' ORDER BY trigger_type) AS trigger_types FROM raw GROUP BY ALL)",
        f"trig AS (SELECT *, {ratio} AS agreement FROM (SELECT trigger, evidence, {sums} FROM kinds GROUP BY ALL))",
    )
    return {
        "A25_A26_chains": (chains, sql(f"""SELECT trigger, chain, trigger_types, by_evidence, headline, observed, coalesce(examples, '') AS examples FROM (SELECT trigger, chain, string_agg({said}, ';' ORDER BY evidence) AS by_evidence, arg_min({said}, {rank}) AS headline FROM kinds GROUP BY ALL)
            JOIN types USING (trigger, chain) JOIN (SELECT trigger, chain, string_agg(form || '/' || {said}, ';' ORDER BY evidence, form) AS observed FROM seen GROUP BY ALL) USING (trigger, chain) LEFT JOIN shown USING (trigger, chain)""", *ctes)),
        "A26_O6_triggers": (triggers, sql(f"""SELECT trigger, patterns, CASE WHEN contains(';' || by_evidence, ';structural:') THEN 0 WHEN contains(';' || by_evidence, ';relational_statement:') THEN 1 ELSE 2 END::INT AS reading_group, trigger_types, by_evidence, headline FROM
            (SELECT trigger, string_agg({said}, ';' ORDER BY evidence) AS by_evidence, arg_min({said}, {rank}) AS headline FROM trig GROUP BY ALL) JOIN (SELECT trigger, count(DISTINCT chain) AS patterns, string_agg(DISTINCT trigger_type, '+' ORDER BY trigger_type) AS trigger_types FROM raw GROUP BY ALL) USING (trigger)""", *ctes)),
        "A26_realizations": (realized, sql("SELECT trigger, chain, row_number() OVER (PARTITION BY trigger, chain ORDER BY pattern, total DESC, key, form)::INT AS place, pattern, key, form, total FROM raw", *ctes)),
    }
