"""Queries over the observation ledger, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from ..operators import agreement as A
from ..operators import cells as C
from ..operators import matching as M
from ..operators import reliability as R
from .fixtures import ledger, sql

DIMENSIONS = {"trigger": ["predicate_lemma"], "pattern": ["evidence_class", "shape", "construction"], "carrier": ["carrier_word"]}
_SHARE = "gold_positive::DOUBLE / support"


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _wilson(s: str, n: str) -> tuple[str, str]:
    z = S.Z
    p = f"({s}::DOUBLE / {n})"
    middle, scale = f"({p} + {z * z} / (2.0 * {n}))", f"(1 + {z * z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})))"
    return f"greatest(0.0, ({middle} - {half}) / {scale})", f"least(1.0, ({middle} + {half}) / {scale})"


def _cells(by: str, name: str = "cells", drop: bool = True, source: str = "ledger") -> str:
    where = "WHERE gold_label IN ('positive', 'negative')" if drop else ""
    return f"""{name} AS (SELECT {by}, count(*) AS support, count(*) FILTER (gold_label = 'positive') AS gold_positive,
        count(*) FILTER (gold_label IS DISTINCT FROM 'positive') AS gold_negative FROM {source} {where} GROUP BY ALL)"""


def dimensions(df: DataFrame) -> DataFrame:
    """The ledger once a dimension, with its joined key; rows without a whole key drop out."""
    keyed = F.array(*(F.struct(F.lit(d).alias("dimension"), K.joined_key(parts).alias("key")) for d, parts in DIMENSIONS.items()))
    return df.select("*", F.inline(keyed)).filter("key IS NOT NULL")


def _dimension_sql() -> str:
    parts = [f"SELECT *, '{d}' AS dimension, {chr(32).join(['concat_ws(', repr(' | '), ',', ', '.join(p), ')'])} AS key FROM ledger WHERE {' AND '.join(f'{x} IS NOT NULL' for x in p)}" for d, p in DIMENSIONS.items()]
    return f"dims AS ({' UNION ALL '.join(parts)})"


def cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.cell_counts(dimensions(ledger(spark, sf)), ["dimension", "corpus", "key"])


def cell_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = C.with_rates(C.cell_counts(dimensions(ledger(spark, sf)), ["dimension", "corpus", "key"]))
    return _round(rates, "cpr", "wilson_low", "wilson_high")


def documents_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Quality by source and language of the labelled documents."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").withColumn("gold_label", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative"))
    return _round(C.with_rates(C.cell_counts(rows, ["source", "lang"])), "cpr", "wilson_low", "wilson_high")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    cells = C.cell_counts(dimensions(ledger(spark, sf)), ["dimension", "corpus", "key"], unlabelled="negative")
    return _round(C.profile(cells, ["corpus", "dimension"]), "mixed_firing_share")


def mixed_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = C.cell_counts(dimensions(ledger(spark, sf)), ["dimension", "corpus", "key"], unlabelled="negative").filter("support >= 5")
    return _round(C.with_consistency(C.with_rates(cells)).filter("kind <> 'unanimous'"), "cpr", "wilson_low", "wilson_high", "label_entropy")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return C.examples(ledger(spark, sf), ["corpus", "predicate_lemma"], "seq", "seq").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return A.pairwise_tests(C.cell_counts(dimensions(ledger(spark, sf)), ["dimension", "corpus", "key"]), ["dimension", "key"], ["dimension"])


def pairwise_tests(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_tests(spark, sf), "cpr_delta_abs", "q_value", digits=9).drop("cpr_1", "cpr_2")


def family_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return A.family_breakdown(_tests(spark, sf), ["dimension"])


def localisation(spark: SparkSession, sf: str) -> DataFrame:
    return A.localisation(_tests(spark, sf))


def primary_family(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.primary_family(_tests(spark, sf).filter("dimension = 'pattern'")), "mean_abs_delta", "significant_share")


_RATE = lambda i: f"(format('{{:.6g}}', positive_{i}::DOUBLE / support_{i}))::DOUBLE"
_LOGP = """lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)
        - lgamma(x + 1) - lgamma(r1 - x + 1) - lgamma(c1 - x + 1) - lgamma(r2 - c1 + x + 1)"""


def _test_ctes(source: str = "cells", min_support: int = 5) -> list[str]:
    """Tests by a sum over all tables with the same margins."""
    side = lambda i: f"SELECT dimension, key, corpus AS corpus_{i}, gold_positive AS positive_{i}, gold_negative AS negative_{i}, support AS support_{i} FROM {source} WHERE support >= {min_support}"
    return [
        f"pairs AS (SELECT * FROM ({side(1)}) JOIN ({side(2)}) USING (dimension, key) WHERE corpus_1 < corpus_2)",
        """margins AS (SELECT *, (positive_1 + negative_1)::DOUBLE AS r1, (positive_2 + negative_2)::DOUBLE AS r2, (positive_1 + positive_2)::DOUBLE AS c1, support_1 + support_2 AS n FROM pairs)""",
        """tables AS (SELECT *, unnest(range(greatest(0, positive_1 + positive_2 - support_2), least(support_1, positive_1 + positive_2) + 1)) AS x FROM margins)""",
        f"likely AS (SELECT *, exp({_LOGP}) AS p FROM tables)",
        f"""fisher AS (SELECT dimension, key, corpus_1, corpus_2, least(1.0, sum(p) FILTER (p <= own + {S.FISHER_SLACK})) AS p FROM
            (SELECT *, max(CASE WHEN x = positive_1 THEN p END) OVER (PARTITION BY dimension, key, corpus_1, corpus_2) AS own FROM likely) GROUP BY ALL)""",
        f"tested AS (SELECT pairs.*, abs({_RATE(1)} - {_RATE(2)}) AS cpr_delta_abs, (format('{{:.6g}}', p))::DOUBLE AS p_value FROM pairs JOIN fisher USING (dimension, key, corpus_1, corpus_2))",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY p_value, key, corpus_1, corpus_2) AS rank, count(*) OVER (PARTITION BY dimension) AS m FROM tested)""",
        """tests AS (SELECT * EXCLUDE (rank, m), least(1.0, min(p_value * m / rank) OVER (PARTITION BY dimension ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM ranked)""",
    ]


def pattern_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _round(R.pattern_reliability(_predictions(spark, sf), ["canonical_key"]), "precision", "wilson_low", "wilson_high", digits=4)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(x) for x in ("evidence_class", "shape", "predicate_lemma", "case_marker", "construction")]
    return ledger(spark, sf).withColumns({"canonical_key": K.canonical_key(*parts), "semantic_key": K.semantic_key(*parts)})


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).filter("predicted_label = 'positive'").withColumn("correct", F.col("gold_label") == "positive")


_KEYS = """keyed AS (SELECT *, concat_ws('|', evidence_class, shape, predicate_lemma, CASE WHEN case_marker = '' THEN '_' ELSE case_marker END, construction) AS canonical_key,
    CASE WHEN shape IN ('AB', 'AB_NMOD', 'AA') THEN concat_ws('|', evidence_class, predicate_lemma)
    ELSE concat_ws('|', evidence_class, shape, predicate_lemma, CASE WHEN case_marker = '' THEN '_' ELSE case_marker END, construction) END AS semantic_key FROM ledger)"""
_PATTERNS = """patterns AS (SELECT canonical_key, any_value(semantic_key) AS semantic_key, count(*) AS total, count(*) FILTER (gold_label = 'positive') AS correct
    FROM keyed WHERE predicted_label = 'positive' GROUP BY canonical_key)"""


def semantic_reliability(spark: SparkSession, sf: str) -> DataFrame:
    patterns = _predictions(spark, sf).groupBy("canonical_key").agg(F.min("semantic_key").alias("semantic_key"), F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))
    return _round(R.semantic_reliability(patterns, "semantic_key", "canonical_key"), "precision")


def channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = R.channel_counts(_keyed(spark, sf), ["canonical_key"], "channel")
    return out.select("canonical_key", F.array_join(F.transform(F.map_entries("channels"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("channels"))


def heterogeneity(spark: SparkSession, sf: str) -> DataFrame:
    cells = C.cell_counts(ledger(spark, sf), ["corpus", "predicate_lemma"])
    return _round(R.heterogeneity(cells, ["predicate_lemma"]), "pooled", "q", "i_squared", digits=5)


def inconsistency(spark: SparkSession, sf: str) -> DataFrame:
    return _round(R.inconsistency(C.cell_counts(ledger(spark, sf), ["corpus", "predicate_lemma"]), ["predicate_lemma"]), "inconsistency")


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    gold = F.when(F.col("gold_label") != "unlabeled", F.col("gold_label") == "positive")
    pair = F.struct(F.least("pair_a", "pair_b").alias("a"), F.greatest("pair_a", "pair_b").alias("b"))
    return R.sentence_sets(ledger(spark, sf), ["corpus", "sentence_id"], pair, F.col("predicted_label") == "positive", gold)


def sentence_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sentences(spark, sf).withColumn("label", R.sentence_label(F.col("pred_pairs"), F.col("gold_pairs")))
    return rows.groupBy("corpus", "label").agg(F.count(F.lit(1)).alias("n"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _round(R.coverage(_sentences(spark, sf), ["corpus"]), "coverage")


_SETS = """sets AS (SELECT corpus, sentence_id, coalesce(list(DISTINCT pair) FILTER (predicted_label = 'positive'), []) AS pred,
    CASE WHEN count(*) FILTER (gold_label <> 'unlabeled') > 0 THEN coalesce(list(DISTINCT pair) FILTER (gold_label = 'positive'), []) END AS gold
    FROM (SELECT *, least(pair_a, pair_b) * 100 + greatest(pair_a, pair_b) AS pair FROM ledger) GROUP BY ALL)"""


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _round(R.confusion(ledger(spark, sf), ["corpus"], F.col("predicted_label") == "positive", F.col("gold_label") == "positive"), "precision", "recall", "f1", "accuracy")


_STRATUM = ["evidence_class", "construction", "predicate_lemma"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).withColumn("positive", (F.col("gold_label") == "positive").cast("int"))


def matched_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _round(M.stratum_gaps(M.stratum_rates(_rows(spark, sf), _STRATUM, "corpus", "positive"), _STRATUM), "gap")


def matched_summary(spark: SparkSession, sf: str) -> DataFrame:
    gaps = M.stratum_gaps(M.stratum_rates(_rows(spark, sf), _STRATUM, "corpus", "positive"), _STRATUM)
    return _round(M.gap_summary(gaps), "mean_gap", "median_gap", "share_big")


def carrier_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """The mean gap with the sentence's carriers as a further key, averaged within the base strata."""
    rows = _rows(spark, sf)
    with_ = M.with_carriers(rows, M.carrier_features(rows, ["corpus", "predicate_lemma"], "carrier_word"), ["corpus", "predicate_lemma"])
    fine = [*_STRATUM, "case_marker", "carriers"]
    return _round(M.mean_gap_by_base(M.stratum_gaps(M.stratum_rates(with_, fine, "corpus", "positive"), fine), _STRATUM), "mean_gap")


def signed_contrast(spark: SparkSession, sf: str) -> DataFrame:
    rates = M.stratum_rates(_rows(spark, sf), _STRATUM, "corpus", "positive")
    return _round(M.signed_contrast(rates, _STRATUM, "corpus", "corpus0", "corpus3"), "mean_d", "sd_d", "mean_abs_d")


def capped_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return M.capped(ledger(spark, sf), "predicate_lemma", "seq", 10).groupBy("predicate_lemma").agg(F.count(F.lit(1)).alias("n"))


def common_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Base strata with a gap at each of three levels."""
    base = ["evidence_class", "predicate_lemma"]
    levels = [M.stratum_gaps(M.stratum_rates(_rows(spark, sf), [*base, *extra], "corpus", "positive"), [*base, *extra]) for extra in ([], ["construction"], ["construction", "case_marker"])]
    return M.common_strata(levels, base)


def significant_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Keys significant both in all rows and in those that aren't negated."""
    cells = lambda df: C.cell_counts(dimensions(df), ["dimension", "corpus", "key"])
    run = lambda df: A.pairwise_tests(cells(df), ["dimension", "key"], ["dimension"])
    rows = ledger(spark, sf)
    return A.significant_overlap(run(rows), run(rows.filter("assertion_status = 'asserted'")), ["dimension", "key"])


def scope_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The cells and mean rate of four nested scopes of decision."""
    scopes = {"applied": ["applied"], "applied_review": ["applied", "review_only"], "not_selected_out": ["applied", "review_only", "not_applied"], "all": ["applied", "review_only", "not_applied", "not_selected"]}
    rows = ledger(spark, sf)
    tagged = rows.withColumn("scope", F.explode(F.filter(F.array(*(F.when(F.col("decision").isin(v), F.lit(k)) for k, v in scopes.items())), lambda x: x.isNotNull())))
    cells = C.cell_counts(tagged, ["scope", "corpus", "predicate_lemma"]).filter("support >= 5")
    return _round(cells.groupBy("scope").agg(F.count(F.lit(1)).alias("cells"), F.avg(S.ratio(F.col("gold_positive"), F.col("support"))).alias("mean_rate")), "mean_rate")


def two_proportions(spark: SparkSession, sf: str) -> DataFrame:
    """z and two-sided p of each corpus against corpus0."""
    cells = C.cell_counts(ledger(spark, sf), ["corpus"])
    one = cells.filter("corpus = 'corpus0'").select(F.col("gold_positive").alias("s0"), F.col("support").alias("n0"))
    z = S.z_two_proportions(F.col("gold_positive"), F.col("support"), F.col("s0"), F.col("n0"))
    rows = cells.filter("corpus <> 'corpus0'").crossJoin(F.broadcast(one)).withColumn("z", z)  # one row
    return _round(rows.withColumn("p_value", 2 * (1 - S.normal_cdf(F.abs("z")))).select("corpus", "z", "p_value"), "z", "p_value", digits=5)


def catalogue() -> dict[str, tuple]:
    """name -> (query, SQL or None)."""
    low, high = _wilson("gold_positive", "support")
    r = lambda x, d=6: f"round({x}, {d})"
    dims = [_dimension_sql(), _cells("dimension, corpus, key", source="dims")]
    negative = [_dimension_sql(), _cells("dimension, corpus, key", drop=False, source="dims")]
    kinds = """kinds AS (SELECT *, least(gold_positive, gold_negative) AS minority, CASE WHEN least(gold_positive, gold_negative) = 0 THEN 'unanimous'
        WHEN least(gold_positive, gold_negative) <= 0.25 * support THEN 'isolated' ELSE 'split' END AS kind FROM cells WHERE support >= 5)"""
    tests = [*dims, *_test_ctes()]
    by_verb = _cells("corpus, predicate_lemma")
    rates = lambda by, name="rates", src="pos": f"{name} AS (SELECT {by}, corpus, count(*) AS n, avg(positive) AS rate FROM {src} GROUP BY ALL HAVING count(*) >= 5)"
    gaps = lambda by, name="gaps", src="rates": f"{name} AS (SELECT {by}, count(*) AS partitions, sum(n)::BIGINT AS rows, max(rate) - min(rate) AS gap FROM {src} GROUP BY {by} HAVING count(*) >= 2)"
    pos = "pos AS (SELECT *, (gold_label = 'positive')::INT AS positive FROM ledger)"
    stratum = ", ".join(_STRATUM)
    vlow, vhigh = _wilson("correct", "total")
    doc_cells = """WITH cells AS (SELECT source, lang, count(*) AS support, count(*) FILTER (quality = 1) AS gold_positive, count(*) FILTER (quality = 0) AS gold_negative
        FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY ALL)"""
    rate_columns = f"{r(_SHARE)} AS cpr, {r(low)} AS wilson_low, {r(high)} AS wilson_high"
    levels = [("a", "evidence_class, predicate_lemma"), ("b", "evidence_class, predicate_lemma, construction"), ("c", "evidence_class, predicate_lemma, construction, case_marker")]
    overlap = [_dimension_sql(), _cells("dimension, corpus, key", source="dims"), *_test_ctes()]
    second = [x.replace("cells AS", "cells2 AS", 1) if x.startswith("cells AS") else x for x in [_cells("dimension, corpus, key", source="dims WHERE assertion_status = 'asserted' AND gold_label IN ('positive', 'negative')", drop=False)]]
    second += [f"{n}2{rest}" for n, rest in ((x.partition(" AS")[0].strip(), " AS" + x.partition(" AS")[2]) for x in _test_ctes("cells2"))]
    for n in ("pairs", "margins", "tables", "likely", "fisher", "tested", "ranked"):
        second = [x.replace(f"FROM {n}\n", f"FROM {n}2\n").replace(f"FROM {n})", f"FROM {n}2)").replace(f"FROM {n} ", f"FROM {n}2 ").replace(f"JOIN {n} ", f"JOIN {n}2 ").replace(f"SELECT {n}.*", f"SELECT {n}2.*") for x in second]
    return {
        "A1_cell_counts": (cell_counts, sql("SELECT * FROM cells", *dims)),
        "A2_cell_rates": (cell_rates, sql(f"SELECT *, {rate_columns} FROM cells", *dims)),
        "A2_document_rates": (documents_rates, f"{doc_cells} SELECT *, {rate_columns} FROM cells"),
        "A3_profile": (profile, sql(f"""SELECT corpus, dimension, sum(support)::BIGINT AS evaluable_firings, coalesce(sum(support) FILTER (kind <> 'unanimous'), 0)::BIGINT AS mixed_firings, count(*) AS assessable_cells,
            count(*) FILTER (kind = 'unanimous') AS unanimous_cells, count(*) FILTER (kind = 'isolated') AS isolated_contrary_cells, count(*) FILTER (kind = 'split') AS split_cells,
            {r("coalesce(sum(support) FILTER (kind <> 'unanimous'), 0)::DOUBLE / sum(support)")} AS mixed_firing_share FROM kinds GROUP BY ALL""", *negative, kinds)),
        "A4_mixed_cells": (mixed_cells, sql(f"""SELECT *, {rate_columns}, {r(f"-({_SHARE}) * log2({_SHARE}) - (1 - {_SHARE}) * log2(1 - {_SHARE})")} AS label_entropy FROM kinds WHERE kind <> 'unanimous'""", *negative, kinds)),
        "A5_examples": (examples, sql("""SELECT corpus, predicate_lemma, CASE WHEN label = major THEN 'majority' ELSE 'contrary' END AS side, string_agg(seq::VARCHAR, ',' ORDER BY rank) AS items
            FROM (SELECT *, row_number() OVER (PARTITION BY corpus, predicate_lemma, label ORDER BY seq) AS rank FROM (SELECT *, CASE WHEN gold_label = 'positive' THEN 'positive' ELSE 'negative' END AS label FROM ledger))
            JOIN (SELECT corpus, predicate_lemma, CASE WHEN gold_positive >= gold_negative THEN 'positive' ELSE 'negative' END AS major FROM cells WHERE gold_positive > 0 AND gold_negative > 0) USING (corpus, predicate_lemma)
            WHERE rank <= 5 GROUP BY ALL""", _cells("corpus, predicate_lemma", drop=False))),
        "J8_T3_T4_pairwise_tests": (pairwise_tests, sql("SELECT * REPLACE (round(cpr_delta_abs, 9) AS cpr_delta_abs, round(q_value, 9) AS q_value) FROM tests", *tests)),
        "A35_family_breakdown": (family_breakdown, sql("SELECT dimension, count(*) AS tests, count(*) FILTER (q_value < 0.05) AS significant FROM tests GROUP BY ALL", *tests)),
        "A37_primary_family": (primary_family, sql(f"""SELECT count(*) AS tests, count(*) FILTER (q_value < 0.05) AS significant, {r('avg(cpr_delta_abs)')} AS mean_abs_delta,
            {r('count(*) FILTER (q_value < 0.05)::DOUBLE / count(*)')} AS significant_share FROM tests WHERE dimension = 'pattern'""", *tests)),
        "A41_localisation": (localisation, sql("SELECT corpus_1, corpus_2, count(*) AS significant FROM tests WHERE q_value < 0.05 GROUP BY ALL", *tests)),
        "A42_U4_significant_overlap": (significant_overlap, sql("SELECT dimension, key FROM tests WHERE q_value < 0.05 INTERSECT SELECT dimension, key FROM tests2 WHERE q_value < 0.05", *overlap, *second)),
        "F4_T28_scope_sensitivity": (scope_sensitivity, sql(f"""SELECT scope, count(*) AS cells, {r(f'avg({_SHARE})')} AS mean_rate FROM cells WHERE support >= 5 GROUP BY scope""",
            """scoped AS (SELECT 'applied' AS scope, * FROM ledger WHERE decision = 'applied' UNION ALL SELECT 'applied_review', * FROM ledger WHERE decision IN ('applied', 'review_only')
            UNION ALL SELECT 'not_selected_out', * FROM ledger WHERE decision IN ('applied', 'review_only', 'not_applied') UNION ALL SELECT 'all', * FROM ledger)""", _cells("scope, corpus, predicate_lemma", source="scoped"))),
        "A6_pattern_reliability": (pattern_reliability, sql(f"""SELECT canonical_key, total, correct, total - correct AS fp, round(correct::DOUBLE / total, 4) AS precision, round({vlow}, 4) AS wilson_low, round({vhigh}, 4) AS wilson_high
            FROM patterns WHERE total >= 5""", _KEYS, _PATTERNS)),
        "A7_semantic_reliability": (semantic_reliability, sql("""SELECT semantic_key, sum(total)::BIGINT AS total, sum(correct)::BIGINT AS correct, string_agg(canonical_key, ',' ORDER BY canonical_key) AS members, round(sum(correct)::DOUBLE / sum(total), 6) AS precision
            FROM patterns GROUP BY semantic_key HAVING sum(total) >= 5""", _KEYS, _PATTERNS)),
        "A9_channel_counts": (channel_counts, sql("SELECT canonical_key, string_agg(channel || '=' || n, ',' ORDER BY channel) AS channels FROM (SELECT canonical_key, channel, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY ALL", _KEYS)),
        "T6_heterogeneity": (heterogeneity, sql("""SELECT predicate_lemma, partitions, round(pooled, 5) AS pooled, round(q, 5) AS q, partitions - 1 AS df, round(CASE WHEN q > 0 THEN greatest(0.0, (q - partitions + 1) / q) ELSE 0 END, 5) AS i_squared,
            coalesce(q > [3.841, 5.991, 7.815, 9.488, 11.07, 12.592][partitions - 1], false) AS heterogeneous
            FROM (SELECT predicate_lemma, any_value(pooled) AS pooled, count(*) AS partitions, coalesce(sum(support * pow(gold_positive::DOUBLE / support - pooled, 2) / nullif(pooled * (1 - pooled), 0)), 0) AS q
            FROM cells JOIN (SELECT predicate_lemma, sum(gold_positive)::DOUBLE / sum(support) AS pooled FROM cells GROUP BY ALL) USING (predicate_lemma) GROUP BY predicate_lemma)""", by_verb)),
        "A47_T7_inconsistency": (inconsistency, sql(f"""SELECT b.predicate_lemma, b.partitions, b.corpus AS highest, w.corpus AS lowest, round(b.rate - w.rate, 6) AS inconsistency, b.low > w.high AS apart
            FROM (SELECT * FROM e WHERE down = 1) b JOIN (SELECT * FROM e WHERE up = 1) w USING (predicate_lemma) WHERE b.partitions >= 2""", by_verb,
            f"""e AS (SELECT *, row_number() OVER (PARTITION BY predicate_lemma ORDER BY rate DESC, corpus) AS down, row_number() OVER (PARTITION BY predicate_lemma ORDER BY rate, corpus) AS up, count(*) OVER (PARTITION BY predicate_lemma) AS partitions
            FROM (SELECT *, {_SHARE} AS rate, {low} AS low, {high} AS high FROM cells WHERE support >= 3))""")),
        "A10_sentence_labels": (sentence_labels, sql("""SELECT corpus, label, count(*) AS n FROM (SELECT corpus, CASE WHEN gold IS NULL THEN 'no_gold' WHEN miss = 0 AND extra = 0 THEN 'correct' WHEN miss = 0 THEN 'too_many' WHEN extra = 0 THEN 'too_few' ELSE 'wrong_pairs' END AS label
            FROM (SELECT *, len(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS miss, len(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS extra FROM sets)) GROUP BY ALL""", _SETS)),
        "A11_U1_coverage": (coverage, sql("""SELECT corpus, sum(g)::BIGINT AS gold, sum(c)::BIGINT AS covered, round(sum(c)::DOUBLE / sum(g), 6) AS coverage FROM
            (SELECT corpus, coalesce(len(gold), 0) AS g, coalesce(len(list_intersect(gold, pred)), 0) AS c FROM sets) GROUP BY ALL""", _SETS)),
        "A19_confusion": (confusion, sql("""SELECT corpus, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM
            (SELECT corpus, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM
            (SELECT corpus, predicted_label = 'positive' AS p, gold_label = 'positive' AS g FROM ledger) GROUP BY ALL)""")),
        "A30_matched_gaps": (matched_gaps, sql("SELECT * REPLACE (round(gap, 6) AS gap) FROM gaps", pos, rates(stratum), gaps(stratum))),
        "A30_matched_summary": (matched_summary, sql("""SELECT count(*) AS strata, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(count(*) FILTER (gap >= 0.3)::DOUBLE / count(*), 6) AS share_big FROM gaps""", pos, rates(stratum), gaps(stratum))),
        "A28_A31_J6_carrier_robustness": (carrier_robustness, sql("SELECT count(*) AS bases, round(avg(gap), 6) AS mean_gap FROM (SELECT avg(gap) AS gap FROM gaps GROUP BY " + stratum + ")", pos,
            "features AS (SELECT corpus, predicate_lemma, string_agg(DISTINCT carrier_word, '+' ORDER BY carrier_word) AS carriers FROM ledger WHERE carrier_word IS NOT NULL GROUP BY ALL)",
            "fine AS (SELECT pos.*, coalesce(carriers, 'none') AS carriers FROM pos LEFT JOIN features USING (corpus, predicate_lemma))", rates(f"{stratum}, case_marker, carriers", src="fine"), gaps(f"{stratum}, case_marker, carriers"))),
        "A29_capped_predicates": (capped_predicates, sql("""SELECT coalesce(top, 'OTHER') AS predicate_lemma, count(*) AS n FROM ledger LEFT JOIN
            (SELECT predicate_lemma AS top FROM ledger GROUP BY ALL ORDER BY count(*) DESC, min(seq) LIMIT 10) ON top = predicate_lemma GROUP BY ALL""")),
        "A33_signed_contrast": (signed_contrast, sql(f"""SELECT count(*) AS strata, round(avg(d), 6) AS mean_d, round(stddev_samp(d), 6) AS sd_d, round(avg(abs(d)), 6) AS mean_abs_d FROM
            (SELECT b.rate - a.rate AS d FROM (FROM rates WHERE corpus = 'corpus0') a JOIN (FROM rates WHERE corpus = 'corpus3') b USING ({stratum}))""", pos, rates(stratum))),
        "A32_U5_common_strata": (common_strata, sql(" INTERSECT ".join(f"SELECT evidence_class, predicate_lemma FROM gaps_{n}" for n, _ in levels), pos, *(x for n, by in levels for x in (rates(by, f"rates_{n}"), gaps(by, f"gaps_{n}", f"rates_{n}"))))),
        # The normal distribution by its series over odd factorials; beyond 7 deviations p is 0 to five digits.
        "T27_two_proportions": (two_proportions, sql("""SELECT corpus, round(z, 5) AS z, round(CASE WHEN abs(z) > 7 THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(300), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))) END, 5) AS p_value FROM
            (SELECT c.corpus, (c.gold_positive / c.support - o.gold_positive / o.support) / sqrt((c.gold_positive + o.gold_positive) / (c.support + o.support) * (1 - (c.gold_positive + o.gold_positive) / (c.support + o.support)) * (1.0 / c.support + 1.0 / o.support)) AS z FROM cells c, cells o WHERE o.corpus = 'corpus0' AND c.corpus <> 'corpus0')""", _cells("corpus"))),
    }
