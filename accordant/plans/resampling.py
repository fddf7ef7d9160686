"""Queries of resampling and held-out models. Those with a closed form have SQL; draws are held to invariants by tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import nulls as N
from ..operators import resample as R
from ..operators.cells import cell_counts
from ..functions import keys as K
from .fixtures import ledger, read, sql

STRATUM = ["evidence_class", "predicate_lemma"]
SEED = 20260908
DRAWS = 10_000
PAIR = ("corpus1", "corpus2")


def _cells(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    return cell_counts(ledger(spark, sf), by, unlabelled="negative").drop("gold_negative")


def shuffle_null(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated-contrary cells with labels shuffled within each corpus, against those seen."""
    cells = _cells(spark, sf, ["corpus", "predicate_lemma", "shape"])
    minority = F.least("gold_positive", F.col("support") - F.col("gold_positive"))
    seen = cells.filter((F.col("support") >= 5) & (minority > 0) & (minority <= 0.25 * F.col("support"))).count()
    return R.null_summary(R.shuffled_labels(cells, ["corpus"], R.isolated_contrary(), DRAWS, SEED), seen, plus_one=False)


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of five rows or more, of strata that two corpora have."""
    return N.eligible(_cells(spark, sf, [*STRATUM, "corpus"]), STRATUM)


def _seen_gap(cells: DataFrame) -> float:
    rate = F.col("gold_positive") / F.col("support")
    return cells.groupBy(*STRATUM).agg((F.max(rate) - F.min(rate)).alias("gap")).agg(F.coalesce(F.avg("gap"), F.lit(0.0))).first()[0]


def gap_null(spark: SparkSession, sf: str) -> DataFrame:
    cells = _strata(spark, sf)
    return R.null_summary(R.gap_null(cells, STRATUM, DRAWS, SEED), _seen_gap(cells))


def _by_document(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    rows = ledger(spark, sf).withColumn("document", K.document_id(F.col("sentence_id"), F.col("corpus")))
    return cell_counts(rows, [*by, "corpus", "document"], unlabelled="negative").drop("gold_negative")


def gap_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return R.interval(N.gap_resamples(_by_document(spark, sf, STRATUM), STRATUM, "corpus", "document", 2000, SEED))


def significant_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Significant tests, tests and their share over resamples of documents: mean and percentile interval."""
    drawn = N.significant_resamples(_by_document(spark, sf, ["predicate_lemma"]), "predicate_lemma", "corpus", "document", 2000, SEED)
    drawn = drawn.filter("tests > 0").withColumn("share", F.col("significant") / F.col("tests"))
    return R.interval(drawn.unpivot(["replicate"], [F.col(x).cast("double").alias(x) for x in ("significant", "tests", "share")], "statistic", "value"), by=("statistic",))


def pair_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """The signed contrast of two corpora: mean and deviation over strata, against shuffled labels, an additive logit, and one that
    is refitted to resampled documents with a random intercept of the residual deviation."""
    cells = _cells(spark, sf, [*STRATUM, "corpus"])
    seen = N.pair_contrast(cells, STRATUM, "corpus", PAIR)
    sigma = float(residual_icc(spark, sf).first()["sigma"] or 0.0)
    nulls = {
        "shuffled": N.pair_shuffles(cells, STRATUM, "corpus", PAIR, DRAWS, SEED),
        "additive": N.pair_additive(cells, STRATUM, "corpus", PAIR, DRAWS, SEED),
        "additive, by document": N.clustered_contrast(_by_document(spark, sf, STRATUM), STRATUM, "corpus", PAIR, "document", 4000, SEED, sigma),
    }
    out = []
    for name, drawn in nulls.items():
        stored = drawn.persist()
        for statistic in ("mean", "sd"):
            part = R.null_summary(stored.select(F.col(statistic).alias("value")).filter("value IS NOT NULL AND NOT isnan(value)"), seen[statistic])
            out.append(part.select(F.lit(name).alias("null"), F.lit(statistic).alias("statistic"), F.lit(seen[statistic]).alias("observed"), "*").first())
        stored.unpersist()
    return spark.createDataFrame(out, "null string, statistic string, observed double, replicates long, mean double, sd double, p95 double, excess double, p_value double")


LEVELS = {"pattern": [], "carrier": ["carrier_word"], "channel": ["channel"], "carrier and channel": ["carrier_word", "channel"]}


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).withColumn("carrier_word", F.coalesce("carrier_word", F.lit("none")))
    cells = {name: cell_counts(rows, [*STRATUM, *extra, "corpus"], unlabelled="negative") for name, extra in LEVELS.items()}
    return N.ladder(cells, STRATUM, "corpus")


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The mean gap at each level over the base keys that all levels have, and how many these are."""
    mean = _ladder(spark, sf).agg(*(F.round(F.avg(f"`{x}`"), 6).alias(x) for x in LEVELS), F.count(F.lit(1)).alias("base_keys"))
    return mean.unpivot(["base_keys"], [f"`{x}`" for x in LEVELS], "level", "mean")


def ladder_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return N.ladder_intervals(_ladder(spark, sf), list(LEVELS), 2000, SEED + 1)


CUES = ["evidence_class", "shape", "case_marker", "construction"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).filter("gold_label <> 'unlabeled'")
    rows = rows.withColumns({"y": (F.col("gold_label") == "positive").cast("int"), "document": K.document_id(F.col("sentence_id"), F.col("corpus"))})
    return rows.withColumn("fold", M.folds_by_hash(["document"]))


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out AUC, log loss and AUC within corpora of the cues alone, with the corpus, with the corpus's base rate, and of the corpus
    alone; and the paired gains over the cues. Means over the folds, with standard errors and normal intervals."""
    metrics = ["auc", "log_loss", "auc_within"]
    models = (("cues", CUES, None), ("cues_corpus", [*CUES, "corpus"], None), ("cues_rate", CUES, "corpus"), ("corpus", ["corpus"], None))
    rows, parts = _rows(spark, sf).persist(), []
    for name, columns, rate in models:
        fitted = M.out_of_fold(rows, columns, "y", carry=("corpus",), rate=rate)
        parts.append(fitted.select(F.lit(name).alias("model"), "fold", "corpus", "y", "n", F.round("p", 9).alias("p")))
    held, key = reduce(lambda a, b: a.unionByName(b), parts).persist(), ["model", "fold"]  # read by each metric, fitted once
    found = M.auc(held, key, "p", "y", "n").join(M.log_loss(held, key, "p", "y", "n"), key).join(M.within_auc(held, key, "corpus", "p", "y", "n"), key, "left")
    found = found.filter("auc IS NOT NULL").select(*key, *metrics)
    each = spark.createDataFrame(found.collect(), found.schema).unpivot(key, metrics, "metric", "value")  # a row a model and fold
    held.unpersist()
    rows.unpersist()
    base = each.filter("model = 'cues'").select("fold", "metric", F.col("value").alias("base"))
    gain = F.when(F.col("metric") == "log_loss", F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    paired = each.filter("model IN ('cues_corpus', 'cues_rate')").join(base, ["fold", "metric"])
    paired = paired.select(F.concat("model", F.lit(" gain")).alias("model"), "fold", "metric", gain.alias("value"))
    out = M.fold_summary(each.unionByName(paired), "value", ("model", "metric"))
    return out.withColumns({x: F.round(x, 6) for x in ("mean", "se", "low", "high")})


def weighted_auc(spark: SparkSession, sf: str) -> DataFrame:
    """How well the quantity of a line ranks its label, weighted by tax."""
    rows = ledger(spark, sf).filter("gold_label <> 'unlabeled'").withColumns({"score": F.col("pair_a") + 7 * F.col("pair_b"), "y": (F.col("gold_label") == "positive").cast("int"), "w": F.col("seq") % 3 + 1})
    return M.auc(rows, ["corpus"], "score", "y", "w").withColumn("auc", F.round("auc", 6))


def within_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).filter("gold_label <> 'unlabeled'").withColumns({"score": F.col("pair_b"), "y": (F.col("gold_label") == "positive").cast("int"), "w": F.lit(1)})
    return M.auc(rows, [], "score", "y", "w").withColumn("auc", F.round("auc", 6))


def lift_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The gain in held-out AUC that the corpus brings to the cues, over resamples of documents: raw, within corpora, and in each."""
    key = ["fold", *CUES]
    base = M.out_of_fold(_rows(spark, sf), CUES, "y").select(*key, F.round("p", 9).alias("base")).distinct()
    other = M.out_of_fold(_rows(spark, sf), [*CUES, "corpus"], "y").select(*key, "corpus", F.round("p", 9).alias("other")).distinct()
    rows = _rows(spark, sf).join(base, key).join(other, [*key, "corpus"])
    return R.interval(M.auc_lift_bootstrap(rows, "document", "corpus", "base", "other", "y", 2000, SEED), by=("scope",))


def additive_null(spark: SparkSession, sf: str) -> DataFrame:
    cells = _strata(spark, sf)
    return R.null_summary(M.additive_null(cells, STRATUM, "corpus", DRAWS, SEED, c=10.0), _seen_gap(cells))


def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out AUC of the cues and of the cues with the corpus: folds by row, folds by document, and of the two largest corpora alone; and
    of the corpus alone."""
    rows = _rows(spark, sf).persist()
    by_row = rows.withColumn("fold", F.pmod(F.xxhash64("seq", F.lit(3)), F.lit(5)).cast("int"))
    largest = rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "corpus").limit(2).select("corpus")
    variants = {"rows": by_row, "documents": rows, "two largest": rows.join(F.broadcast(largest), "corpus", "left_semi")}
    out = []
    for name, some in variants.items():
        models = {"cues": CUES, "cues and corpus": [*CUES, "corpus"]} | ({"corpus": ["corpus"]} if name == "rows" else {})
        for model, columns in models.items():
            held = M.out_of_fold(some, columns, "y").withColumn("p", F.round("p", 9))
            out.append((name, model, M.auc(held, [], "p", "y", "n").first()["auc"]))
    rows.unpersist()
    return spark.createDataFrame(out, "folds string, model string, auc double").withColumn("auc", F.round("auc", 4))


STOP = ["the", "of", "and", "to", "is", "it", "in"]


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "source", M.words_of(F.col("text"), STOP).alias("words"))
    return docs.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").filter("quality IS NOT NULL")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return M.vocabulary(_texts(spark, sf), "words").select("word", "documents")


def text_control(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out AUC of quality from the words of a document, without and with its source."""
    rows = _texts(spark, sf).withColumn("fold", M.folds_by_hash(["doc_id"]))
    held = M.text_models(rows, "words", "quality", "fold", {"words": [], "words_source": ["source"]})
    scored = held.withColumns({"p": F.round("p", 6), "n": F.lit(1)})
    return M.auc(scored, ["fold", "model"], "p", "quality", "n").select("fold", F.round("auc", 4).alias("auc"), "model")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).withColumns({"y": (F.col("gold_label") == "positive").cast("double"), "document": K.document_id(F.col("sentence_id"), F.col("corpus"))})


def residual_icc(spark: SparkSession, sf: str) -> DataFrame:
    """The correlation within documents of what corpus and stratum leave of the label."""
    rows = N.pearson_residuals(_labelled(spark, sf), STRATUM, "corpus", "y")
    return M.document_icc(rows, "document", "residual").withColumns({"icc": F.round("icc", 6), "sigma": F.round("sigma", 5)})


def icc(spark: SparkSession, sf: str) -> DataFrame:
    """The correlation within sentences of the label less its cell's rate. (Most sentences have several rows, some one.)"""
    rows = _labelled(spark, sf)
    rate = rows.groupBy(*STRATUM, "corpus").agg(F.avg("y").alias("p"))
    left = rows.join(rate, [*STRATUM, "corpus"]).withColumn("left", F.col("y") - F.col("p"))
    return M.document_icc(left, "sentence_id", "left").withColumns({"icc": F.round("icc", 6), "sigma": F.round("sigma", 5)})


def balanced_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).drop("fold")
    return rows.join(M.folds_by_size(rows, "document"), "document").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("documents"))


def catalogue() -> dict[str, tuple]:
    auc = "SELECT {g} round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({x})) {o}"
    return {
        "T8_shuffle_null": (shuffle_null, None),
        "T9_gap_null": (gap_null, None),
        "T11_gap_bootstrap": (gap_bootstrap, None),
        "T18_T20_model_comparison": (model_comparison, None),
        "T22_balanced_folds": (balanced_folds, sql("""SELECT fold, sum(n)::BIGINT AS n, count(*) AS documents FROM walk WHERE place > 0 GROUP BY fold""",
            "docs AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n DESC, document) AS place FROM (SELECT split_part(sentence_id, '.', 1) || '.' || split_part(sentence_id, '.', 2) AS document, count(*) AS n FROM ledger WHERE gold_label <> 'unlabeled' GROUP BY ALL))",
            """walk AS (SELECT 0::BIGINT AS place, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1 AS fold, 0::BIGINT AS n UNION ALL SELECT d.place, list_transform(range(1, 6), lambda i: (loads[i] + CASE WHEN i = f THEN d.n ELSE 0 END)::BIGINT), (f - 1)::INT, d.n
                FROM (SELECT *, list_position(loads, list_min(loads)) AS f FROM walk) w JOIN docs d ON d.place = w.place + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)),
        "T24_lift_bootstrap": (lift_bootstrap, None),
        "T10_additive_null": (additive_null, None),
        "T12_T13_pair_contrast": (pair_contrast, None),
        "T14_residual_icc": (residual_icc, None),
        "T16_ladder_intervals": (ladder_intervals, None),
        "T17_significant_bootstrap": (significant_bootstrap, None),
        "T21_robustness": (robustness, None),
        "T16_A32_ladder": (ladder, sql("SELECT base_keys, level, mean FROM (UNPIVOT (SELECT round(avg(g0), 6) AS pattern, round(avg(g1), 6) AS carrier, round(avg(g2), 6) AS channel, round(avg(g3), 6) AS \"carrier and channel\", count(*) AS base_keys FROM l0 JOIN l1 USING (evidence_class, predicate_lemma) JOIN l2 USING (evidence_class, predicate_lemma) JOIN l3 USING (evidence_class, predicate_lemma)) ON pattern, carrier, channel, \"carrier and channel\" INTO NAME level VALUE mean)", *(
            f"""l{i} AS (SELECT evidence_class, predicate_lemma, avg(gap) AS g{i} FROM (SELECT evidence_class, predicate_lemma, x, y, max(r) - min(r) AS gap FROM (SELECT evidence_class, predicate_lemma, corpus, {x} AS x, {y} AS y, count(*) FILTER (gold_label = 'positive') / count(*) AS r FROM ledger GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)"""
            for i, (x, y) in enumerate((("1", "1"), ("coalesce(carrier_word, 'none')", "1"), ("1", "channel"), ("coalesce(carrier_word, 'none')", "channel")))))),
        "T25_vocabulary": (vocabulary, r"""SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}][\p{L}\p{N}_\p{M}]+')) AS word FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
            WHERE word NOT IN ('the', 'of', 'and', 'to', 'is', 'it', 'in') GROUP BY word HAVING count(*) >= 10 ORDER BY documents DESC, word LIMIT 800"""),
        "T25_T26_text_control": (text_control, None),
        "T23_weighted_auc": (weighted_auc, sql(auc.format(g="corpus,", k="corpus", o="GROUP BY corpus", x="""SELECT corpus, pair_a + 7 * pair_b AS score, sum(CASE WHEN gold_label = 'positive' THEN seq % 3 + 1 ELSE 0 END) AS p,
            sum(CASE WHEN gold_label = 'positive' THEN 0 ELSE seq % 3 + 1 END) AS n FROM ledger WHERE gold_label <> 'unlabeled' GROUP BY ALL"""))),
        "T23_plain_auc": (within_auc, sql(auc.format(g="", k="1", o="", x="""SELECT pair_b AS score, count(*) FILTER (gold_label = 'positive') AS p, count(*) FILTER (gold_label <> 'positive') AS n FROM ledger WHERE gold_label <> 'unlabeled' GROUP BY ALL"""))),
        "T14_document_icc": (icc, sql("""SELECT k AS clusters, round(icc, 6) AS icc, round(sqrt(icc / (1 - icc) * pi() * pi() / 3), 5) AS sigma FROM (SELECT k, greatest(0.0, (between_ - within_) / (between_ + (size - 1) * within_)) AS icc FROM
            (SELECT k, between_ / (k - 1) AS between_, within_ / (n - k) AS within_, (n - nn / n) / (k - 1) AS size FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum(n * (m - g) ** 2) AS between_, sum(q - n * m * m) AS within_ FROM
            (SELECT sentence_id, count(*) AS n, avg(v) AS m, sum(v * v) AS q, any_value(g) AS g FROM (SELECT sentence_id, v, avg(v) OVER () AS g FROM (SELECT sentence_id, y - avg(y) OVER (PARTITION BY evidence_class, predicate_lemma, corpus) AS v FROM (SELECT *, (gold_label = 'positive')::INT AS y FROM ledger))) GROUP BY 1) WHERE n > 1)))""")),
    }
