"""Queries over records, pairs and texts, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import evidence as E
from ..operators.cells import first_of_group
from .fixtures import ledger, read, sql


def pairs_of_records(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of the line items of an order, as many as each status has."""
    n = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = n.select(F.inline(E.all_pairs(F.col("n"))))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def corpus_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Records, those with a positive pair, possible pairs n(n-1)/2 and positive ones, by order priority."""
    items = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("p"))
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(items, "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("p") > 0).alias("with_positive"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("p").alias("positive")
    )


def aligned_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the parts and suppliers of an order: by position where there are equally many distinct ones, else each with each."""
    sets = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_partkey") % 9)).alias("parts"), F.array_sort(F.collect_set(F.col("l_suppkey") % 4)).alias("suppliers")
    )
    rows = sets.select(F.inline(E.group_pairs(F.col("parts"), F.col("suppliers"), F.size("parts") == F.size("suppliers"))))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as proposals, orders as plans: a plan's final pairs are its discounted items."""
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("pair"), "l_discount")
    orders = read(spark, sf, "orders").filter("o_orderpriority <> '1-URGENT'")
    status = F.when(F.col("o_orderstatus") == "F", "review_only").when(F.col("o_orderstatus") == "O", "not_applied").otherwise("applied")
    final = items.groupBy("event").agg(F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("pair"))).alias("final_pairs"))
    plans = orders.select(F.col("o_orderkey").alias("event"), status.alias("status")).join(final, "event")
    return E.annotate_decisions(items, plans, ["event"]).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stage of each ledger row's pair."""
    flag = lambda m, r=0: (F.col("seq") % m) == r
    stage = E.stage(F.col("decision") == "applied", F.col("predicted_label") == "positive", F.col("assertion_status") == "asserted", F.col("evidence_class") == "relational", flag(3), flag(5), flag(2))
    rows = ledger(spark, sf).filter("gold_label = 'positive'").withColumn("stage", stage)
    return rows.groupBy("corpus", "stage").agg(F.count(F.lit(1)).alias("n"))


def merged_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return E.merge_proposals(ledger(spark, sf).filter("pair_a <> pair_b").withColumn("pair", K.pair(F.col("pair_a"), F.col("pair_b"))).select("*", "pair.a", "pair.b"), ["corpus", "a", "b"], F.col("assertion_status") == "asserted", F.col("evidence_class") == "relational")


def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """Gold pairs by the first tier that has them."""
    committed = (F.col("decision") == "applied") & (F.col("predicted_label") == "positive")
    flags = {
        **{c: F.max(committed & (F.col("channel") == c)) for c in ("clause", "event_nominal", "state")},
        "held": F.max(F.col("decision") == "review_only"),
        "path": F.max(F.col("carrier_word").isNotNull()),
    }
    gold = ledger(spark, sf).filter("gold_label = 'positive'").groupBy("corpus", "sentence_id", "pair_a", "pair_b").agg(*(v.alias(k) for k, v in flags.items()))
    return E.waterfall(gold.withColumn("tier", E.tier({k: F.col(k) for k in flags})), "corpus", "tier")


def preceding_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's time since the user's last purchase, averaged by type."""
    # By calendar fields: no session time zone comes into it.
    at = F.expr("(unix_date(to_date(ts)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000 + cast(extract(SECOND FROM ts) * 1000000 as bigint)")
    events = read(spark, sf, "events").withColumn("at", at)
    rows = E.preceding(events, ["user_id"], ["at", "event_id"], F.col("event_type") == "purchase", "at", "since")
    return rows.groupBy("event_type").agg(F.count("since").alias("n"), F.sum(F.col("at") - F.col("since")).alias("micros"))


def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a customer's orders whose spans from order to last shipment overlap."""
    ship = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = read(spark, sf, "orders").join(ship, "o_orderkey").filter("shipped > o_orderdate")
    groups = E.overlap_groups(rows, ["o_custkey"], "o_orderdate", "shipped")
    return groups.groupBy("o_custkey", "group").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first"))


def fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows with the carrier of their sentence and lemma, else the one of lemma and shape where there is one alone."""
    rows = ledger(spark, sf)
    source = rows.filter("carrier_word IS NOT NULL")
    out = E.with_fallback(rows.select("sentence_id", "predicate_lemma", "shape", "case_marker"), source, ["sentence_id", "predicate_lemma"], source, ["predicate_lemma", "shape", "case_marker"], "carrier_word")
    return out.groupBy("carrier_word").agg(F.count(F.lit(1)).alias("n"))


def id_differences(spark: SparkSession, sf: str) -> DataFrame:
    return E.id_differences(read(spark, sf, "labels").select("doc_id"), read(spark, sf, "documents").filter("lang <> 'en'").select("doc_id"), "doc_id")


def left_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with how many orders they have and their statuses, those without orders too."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    joined = read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
    return joined.groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("orders"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"))


def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are labelled toxic."""
    toxic = read(spark, sf, "labels").filter("toxic = 1")
    return read(spark, sf, "documents").select("doc_id", "lang").join(toxic, "doc_id", "left_semi")


def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 most frequent patterns of each carrier word."""
    counts = ledger(spark, sf).filter("carrier_word IS NOT NULL").groupBy("carrier_word", "predicate_lemma", "shape").agg(F.count(F.lit(1)).alias("n"))
    return first_of_group(counts, ["carrier_word"], [F.desc("n"), "predicate_lemma", "shape"], 12)


def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """One row a (lemma, pair): the first in input order; its mentions and distinct sentences."""
    key = ["predicate_lemma", "pair_a", "pair_b"]
    rows = ledger(spark, sf)
    return rows.groupBy(*key).agg(F.min_by("decision", "seq").alias("decision"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("sentence_id").alias("sentences"))


def key_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical keys apart again, with the document of the sentence."""
    parts = [F.col(x) for x in ("evidence_class", "shape", "predicate_lemma", "case_marker", "construction")]
    rows = ledger(spark, sf).withColumn("k", K.canonical_key(*parts)).withColumn("doc", K.document_id(F.col("sentence_id"), F.col("corpus")))
    return rows.groupBy("doc", K.key_part(F.col("k"), 3).alias("case_marker"), K.key_part(F.col("k"), 7).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with any, and with all, of a lexicon's words."""
    words = F.split(F.lower(F.regexp_replace("text", r"[^A-Za-z ]", " ")), " +")
    lexicon = F.array(*(F.lit(x) for x in ("the", "of", "and", "was")))
    rows = read(spark, sf, "documents").select("lang", words.alias("w"))
    return rows.groupBy("lang").agg(F.count_if(F.arrays_overlap("w", lexicon)).alias("any_word"), F.count_if(F.size(F.array_except(lexicon, "w")) == 0).alias("all_words"))


def json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the JSON properties of events by type; what doesn't parse counts as absent."""
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf, "events").groupBy("event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("k"), F.count_if(k.isNull()).alias("absent"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in page addresses, extracted and masked."""
    rows = read(spark, sf, "pages").select("page_id", F.regexp_extract_all("url", F.lit(r"(\d+)"), 1).alias("n"), F.regexp_replace("url", r"\d+", "#").alias("masked"))
    return rows.select("page_id", F.array_join("n", ",").alias("numbers"), "masked")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """yes, no and uncertain of two rated questions, by language and for all, and the share of yes among the definite."""
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("lang", "quality", "toxic")
    answer = lambda c: F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no").otherwise("uncertain")
    long = rows.select("lang", answer("quality").alias("quality"), answer("toxic").alias("toxic")).unpivot(["lang"], ["quality", "toxic"], "question", "answer")
    out = long.rollup("question", "lang").agg(*(F.count_if(F.col("answer") == a).alias(a) for a in ("yes", "no", "uncertain"))).filter("question IS NOT NULL")
    return out.withColumns({"lang": F.coalesce("lang", F.lit("all")), "share": F.round(F.col("yes") / F.nullif(F.col("yes") + F.col("no"), F.lit(0)), 6)})


def review_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of lemma and case by agreement."""
    cells = ledger(spark, sf).groupBy("predicate_lemma", "case_marker", "corpus").agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col("gold_label") != "unlabeled").alias("evaluable"), F.count_if(F.col("gold_label") == "positive").alias("p"))
    rate = F.col("p") / F.nullif(F.col("evaluable"), F.lit(0))
    return cells.withColumn("signal", K.review_signal(rate, F.col("observed"), F.col("evaluable"))).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "))
    raw = F.when(F.col("event_id") % 4 == 0, " Negated").when(F.col("event_id") % 4 == 1, "").otherwise(raw)
    return read(spark, sf, "events").groupBy(K.assertion(raw).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def input_order_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of exact size, the 50 documents of least hash, in the order of the corpus."""
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return docs.orderBy(F.md5(F.concat_ws("-", F.lit("7"), F.col("doc_id").cast("string")))).limit(50).orderBy("doc_id")


def wide_union(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers as one table with their kind, absent columns null."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nation", "segment").agg(F.count(F.lit(1)).alias("n"))


def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders with rank by price and the running total."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf, "orders").withColumns({"place": F.row_number().over(w), "best": F.max("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.select("o_orderkey", "place", F.round("best", 2).alias("best"))


def catalogue() -> dict[str, tuple]:
    return {
        "J9_all_pairs": (pairs_of_records, """SELECT (a.i)::INT AS a, (b.i)::INT AS b, sum(m)::BIGINT AS n FROM (SELECT n, count(*) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n),
            (SELECT unnest(range(20)) AS i) a, (SELECT unnest(range(20)) AS i) b WHERE a.i < b.i AND b.i < n GROUP BY ALL"""),
        "A45_corpus_metadata": (corpus_metadata, """SELECT o_orderpriority, count(*) AS records, count(*) FILTER (p > 0) AS with_positive, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(p)::BIGINT AS positive FROM orders JOIN
            (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY ALL"""),
        "J11_J12_group_alignment": (aligned_groups, """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 9)) AS p, list_sort(list(DISTINCT l_suppkey % 4)) AS s FROM lineitem GROUP BY 1),
            x AS (SELECT l_orderkey, len(p) = len(s) AS diagonal, p, s, unnest(range(1, len(p) + 1)) AS i FROM s), y AS (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM x)
            SELECT p[i] AS a, s[j] AS b, count(*) AS n FROM y WHERE NOT diagonal OR i = j GROUP BY ALL"""),
        "P20_J13_decisions": (decisions, """SELECT CASE WHEN o_orderkey IS NULL THEN 'not_selected' WHEN d THEN 'applied' WHEN o_orderstatus = 'F' THEN 'review_only' WHEN o_orderstatus = 'O' THEN 'not_applied' ELSE 'not_selected' END AS decision,
            count(*) AS n FROM (SELECT l_orderkey, bool_or(l_discount > 0.05) OVER (PARTITION BY l_orderkey, l_linenumber) AS d FROM lineitem) LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON l_orderkey = o_orderkey GROUP BY ALL"""),
        "E24_A43_stages": (stages, sql("""SELECT corpus, CASE WHEN decision = 'applied' THEN 'emitted' WHEN predicted_label = 'positive' AND evidence_class = 'relational' THEN 'held_relational'
            WHEN predicted_label = 'positive' AND assertion_status <> 'asserted' THEN 'held_not_asserted' WHEN predicted_label = 'positive' THEN 'held_proposed' WHEN seq % 3 = 0 THEN 'same_event_unprojected'
            WHEN seq % 5 = 0 THEN 'ends_in_other_events' WHEN seq % 2 = 0 THEN 'one_end_in_an_event' ELSE 'no_event' END AS stage, count(*) AS n FROM ledger WHERE gold_label = 'positive' GROUP BY ALL""")),
        "A44_merged_proposals": (merged_proposals, sql("""SELECT corpus, least(pair_a, pair_b) AS a, greatest(pair_a, pair_b) AS b, bool_or(assertion_status = 'asserted') AS asserted, bool_and(evidence_class = 'relational') AS relational, count(*) AS proposals
            FROM ledger WHERE pair_a <> pair_b GROUP BY ALL""")),
        "A34_J15_waterfall": (waterfall, sql("""SELECT coalesce(corpus, 'all') AS corpus, tier, count(*) AS n FROM (SELECT corpus, CASE WHEN bool_or(c AND channel = 'clause') THEN 'clause' WHEN bool_or(c AND channel = 'event_nominal') THEN 'event_nominal'
            WHEN bool_or(c AND channel = 'state') THEN 'state' WHEN bool_or(decision = 'review_only') THEN 'held' WHEN bool_or(carrier_word IS NOT NULL) THEN 'path' ELSE 'none' END AS tier
            FROM (SELECT *, decision = 'applied' AND predicted_label = 'positive' AS c FROM ledger WHERE gold_label = 'positive') GROUP BY corpus, sentence_id, pair_a, pair_b) GROUP BY GROUPING SETS ((corpus, tier), (tier))""")),
        "J23_preceding_purchase": (preceding_purchase, """SELECT event_type, count(since) AS n, sum(moment - since)::BIGINT AS micros FROM (SELECT event_type, moment, last_value(CASE WHEN event_type = 'purchase' THEN moment END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM (SELECT *, epoch_us(ts) AS moment FROM events)) GROUP BY ALL"""),
        "J19_overlap_groups": (overlaps, """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, shipped AS e FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE shipped > o_orderdate),
            b AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
            g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM b)
            SELECT o_custkey, grp::BIGINT AS "group", count(*) AS orders, min(o_orderkey) AS first FROM g GROUP BY ALL"""),
        "J16_fallback": (fallback, sql("""SELECT coalesce(e.w, l.w) AS carrier_word, count(*) AS n FROM ledger r
            LEFT JOIN (SELECT sentence_id, predicate_lemma, min(carrier_word) AS w FROM src GROUP BY ALL) e ON r.sentence_id = e.sentence_id AND r.predicate_lemma = e.predicate_lemma
            LEFT JOIN (SELECT predicate_lemma, shape, case_marker, min(carrier_word) AS w FROM src GROUP BY ALL HAVING count(DISTINCT carrier_word) = 1) l ON r.predicate_lemma = l.predicate_lemma AND r.shape = l.shape AND r.case_marker = l.case_marker GROUP BY ALL""",
            "src AS (SELECT * FROM ledger WHERE carrier_word IS NOT NULL)")),
        "J18_U6_id_differences": (id_differences, """SELECT doc_id, 'first' AS only_in FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')
            UNION ALL SELECT doc_id, 'second' FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)"""),
        "J2_U7_left_join_sets": (left_joins, """SELECT c_custkey, c_nationkey, count(o_orderkey) AS orders, coalesce(string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus), '') AS statuses FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL"""),
        "J7_semi_join": (semi_join, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
        "O3_A21_top_per_group": (top_per_group, sql("""SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY carrier_word ORDER BY n DESC, predicate_lemma, shape))::INT AS rank FROM
            (SELECT carrier_word, predicate_lemma, shape, count(*) AS n FROM ledger WHERE carrier_word IS NOT NULL GROUP BY ALL)) WHERE rank <= 12""")),
        "A12_first_wins": (first_wins, sql("SELECT predicate_lemma, pair_a, pair_b, arg_min(decision, seq) AS decision, count(*) AS mentions, count(DISTINCT sentence_id) AS sentences FROM ledger GROUP BY ALL")),
        "P11_P12_P19_key_parts": (key_parts, sql("""SELECT string_split(sentence_id, '.')[1] || '.' || string_split(sentence_id, '.')[2] AS doc, case_marker, '' AS missing, count(*) AS n FROM ledger GROUP BY ALL""")),
        "F14_lexicon_matches": (lexicon_matches, """SELECT lang, count(*) FILTER (list_has_any(w, ['the', 'of', 'and', 'was'])) AS any_word, count(*) FILTER (list_has_all(w, ['the', 'of', 'and', 'was'])) AS all_words FROM
            (SELECT lang, string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' +') AS w FROM documents) GROUP BY ALL"""),
        "JSON_values": (json_values, """SELECT event_type, sum(coalesce((props->>'$.k')::BIGINT, 0))::BIGINT AS k, count(*) FILTER (props->>'$.k' IS NULL) AS absent FROM events GROUP BY ALL"""),
        "S21_F17_markers": (markers, r"SELECT page_id, array_to_string(regexp_extract_all(url, '\d+'), ',') AS numbers, regexp_replace(url, '\d+', '#', 'g') AS masked FROM pages"),
        "A39_J17_ratings": (ratings, """WITH l AS (SELECT lang, 'quality' AS question, quality AS v FROM documents JOIN labels USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM documents JOIN labels USING (doc_id))
            SELECT question, coalesce(lang, 'all') AS lang, count(*) FILTER (v = 1) AS yes, count(*) FILTER (v = 0) AS no, count(*) FILTER (v IS NULL OR v NOT IN (0, 1)) AS uncertain,
            round(count(*) FILTER (v = 1)::DOUBLE / nullif(count(*) FILTER (v IN (0, 1)), 0), 6) AS share FROM l GROUP BY GROUPING SETS ((question, lang), (question))"""),
        "F20_review_signals": (review_signals, sql("""SELECT CASE WHEN observed >= 5 AND evaluable >= 5 AND p::DOUBLE / evaluable >= 0.8 THEN 'high' WHEN observed >= 5 AND evaluable >= 5 AND p::DOUBLE / evaluable <= 0.2 THEN 'low'
            WHEN evaluable >= 3 THEN 'mixed' ELSE 'insufficient' END AS signal, count(*) AS n FROM (SELECT count(*) AS observed, count(*) FILTER (gold_label <> 'unlabeled') AS evaluable, count(*) FILTER (gold_label = 'positive') AS p
            FROM ledger GROUP BY predicate_lemma, case_marker, corpus) GROUP BY ALL""")),
        "D_assertion_status": (assertions, "SELECT CASE event_id % 4 WHEN 0 THEN 'negated' WHEN 1 THEN 'asserted' ELSE 'uncertain' END AS status, count(*) AS n FROM events GROUP BY ALL"),
        "S18_S19_sample": (input_order_sample, "SELECT doc_id, lang FROM documents ORDER BY md5('7-' || doc_id) LIMIT 50"),
        "U3_A48_union": (wide_union, """SELECT kind, nation, segment, count(*) AS n FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, NULL, 'supplier' FROM supplier) GROUP BY ALL"""),
        "W_running": (running_best, "SELECT o_orderkey, (row_number() OVER w)::INT AS place, round(max(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS best FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    }
