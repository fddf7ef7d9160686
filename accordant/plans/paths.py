"""Queries over trees, graphs, paths and a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import paths as P
from ..scratch import folder
from ..streaming.cells import drain, streamed_cells
from .fixtures import ledger, read, sql


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """An order's items as a tree: item i's head is item (i - 1) div 2, and every third order falls into two trees."""
    items = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("l_partkey").alias("s"))
    cut = (F.col("id") % 3 == 0) & (F.col("n") > 2)
    heads = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when((i == 0) | (cut & (i == 2)), -1).otherwise(F.floor((i - 1) / 2).cast("int")))
    return items.withColumns({"heads": heads, "a": (F.col("s") % F.col("n")).cast("int"), "b": F.col("n") - 1})


def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf).select("id", G.ancestors(F.col("heads"), F.col("a"), 16).alias("ua"), G.ancestors(F.col("heads"), F.col("b"), 16).alias("ub"))
    return rows.select("id", F.array_join(G.tree_path(F.col("ua"), F.col("ub"), 4), "-").alias("path"))


def identity_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of the supplier numbers (mod 12) of an order, joined by its items."""
    edge = F.struct((F.col("l_suppkey") % 12).cast("int").alias("a"), (F.col("l_partkey") % 12).cast("int").alias("b"))
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    return rows.select("l_orderkey", F.array_join(G.identity_closure(F.lit(12), F.col("edges")), ",").alias("classes"))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events: returned items are sources, the others targets. Events without pairs count as (-1, -1)."""
    part = (F.col("l_partkey") % 8).cast("int")
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", part))).alias("s"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", part))).alias("t"), F.array_sort(F.collect_set(part)).alias("p")
    )
    k = F.col("l_orderkey")
    assertion = F.when(k % 7 == 0, "negated").otherwise("asserted")
    pairs, reason = G.projected_pairs(assertion, k % 5 == 0, k % 2 == 0, F.col("s"), F.col("t"), F.col("p"), k % 3 == 0)
    return rows.select(pairs.alias("pairs"), reason.alias("reason")).select("reason", F.explode_outer("pairs").alias("p")).groupBy("reason", F.coalesce("p.a", F.lit(-1)).alias("a"), F.coalesce("p.b", F.lit(-1)).alias("b")).agg(F.count(F.lit(1)).alias("events"))


def families(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).withColumn("signature", F.concat_ws("/", "predicate_lemma", P.preposition(F.col("case_marker"))))
    return P.families(rows, ["signature"], "sentence_id", ["pair_a", "pair_b"], "seq", F.col("gold_label") == "positive")


def semantic_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).withColumn("signature", F.concat_ws("/", "predicate_lemma", P.preposition(F.col("case_marker"))))
    fams = rows.groupBy("predicate_lemma", "signature").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("gold_label") == "positive").alias("agreeing"))
    return P.by_semantic_signature(fams, ["predicate_lemma"], "signature")


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    words = read(spark, sf, "lineitem").select((F.col("l_partkey") % 11).alias("k")).distinct()
    both = F.explode(F.array(F.when(F.col("k") % 2 == 0, "process"), F.when(F.col("k") % 3 == 0, "location"), F.when(F.col("k") % 5 == 0, "metric")))
    return words.select(F.concat(F.lit("noun"), F.col("k").cast("string")).alias("word"), both.alias("class")).filter("class IS NOT NULL")


def head_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.head_classes(ledger(spark, sf), "carrier_word", _lexicon(spark, sf), ["metric", "location", "process"])
    return rows.groupBy("head_class").agg(F.count(F.lit(1)).alias("n"))


def class_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_signature(ledger(spark, sf), ["corpus", "predicate_lemma", "shape"], "carrier_word", _lexicon(spark, sf)).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Events a day and type, and those over the middle value, by a stream that reads the table once."""
    table = read(spark, sf, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))
    cells = drain(streamed_cells(stream, "at", ["event_type"], F.col("value") > 50), f"{folder(spark)}/streamed-{uuid.uuid4().hex}", ["start", "event_type"])
    return cells.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "support", "gold_positive")


def catalogue() -> dict[str, tuple]:
    lex = """lex AS (SELECT 'noun' || k AS word, class FROM (SELECT DISTINCT l_partkey % 11 AS k FROM lineitem), (SELECT unnest(['process', 'location', 'metric']) AS class)
        WHERE (class = 'process' AND k % 2 = 0) OR (class = 'location' AND k % 3 = 0) OR (class = 'metric' AND k % 5 = 0))"""
    prep = "CASE WHEN case_marker = '' THEN '_' ELSE case_marker END"
    return {
        "J22_tree_path": (tree_paths, """WITH RECURSIVE o AS (SELECT l_orderkey AS id, count(*)::INT AS n, sum(l_partkey) AS s FROM lineitem GROUP BY 1),
            c AS (SELECT id, n, (s % n)::INT AS a, n - 1 AS b FROM o),
            up(id, n, side, node, depth) AS (SELECT id, n, 'a', a, 0 FROM c UNION ALL SELECT id, n, 'b', b, 0 FROM c UNION ALL
                SELECT id, n, side, (node - 1) // 2, depth + 1 FROM up WHERE node > 0 AND NOT (id % 3 = 0 AND n > 2 AND node = 2)),
            apex AS (SELECT x.id, min(x.depth) AS da, min(y.depth) AS db FROM up x JOIN up y ON x.id = y.id AND x.node = y.node AND x.side = 'a' AND y.side = 'b' GROUP BY x.id),
            p AS (SELECT up.id, node, side, depth, CASE WHEN side = 'a' THEN depth ELSE 1000 - depth END AS place FROM up JOIN apex USING (id) WHERE da + db <= 4 AND ((side = 'a' AND depth <= da) OR (side = 'b' AND depth < db)))
            SELECT c.id, coalesce(string_agg(node::VARCHAR, '-' ORDER BY place), '') AS path FROM c LEFT JOIN p USING (id) GROUP BY c.id"""),
        "J21_E20_identity_closure": (identity_closure, """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 12 AS a, l_partkey % 12 AS b FROM lineitem), s AS (SELECT id, a, b FROM e UNION SELECT id, b, a FROM e),
            n AS (SELECT DISTINCT id, unnest(range(12)) AS v FROM e), r(id, v, w) AS (SELECT id, v, v FROM n UNION SELECT r.id, r.v, s.b FROM r JOIN s ON r.id = s.id AND r.w = s.a)
            SELECT id AS l_orderkey, string_agg(m::VARCHAR, ',' ORDER BY v) AS classes FROM (SELECT id, v, min(w) AS m FROM r GROUP BY ALL) GROUP BY id"""),
        "E19_E21_projected_pairs": (projected, """WITH o AS (SELECT l_orderkey AS k, list_sort(coalesce(list(DISTINCT l_partkey % 8) FILTER (l_returnflag = 'R'), [])) AS s, list_sort(coalesce(list(DISTINCT l_partkey % 8) FILTER (l_returnflag <> 'R'), [])) AS t,
            list_sort(list(DISTINCT l_partkey % 8)) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'not_asserted' WHEN k % 5 = 0 THEN 'relational' WHEN k % 2 = 0 AND k % 3 = 0 AND len(s) = len(t) THEN 'aligned' WHEN k % 2 = 0 THEN 'directed' ELSE 'undirected' END AS reason FROM o),
            x AS (SELECT k, reason, unnest(range(1, len(CASE WHEN reason = 'undirected' THEN p ELSE s END) + 1)) AS i, CASE WHEN reason = 'undirected' THEN p ELSE s END AS l, CASE WHEN reason = 'undirected' THEN p ELSE t END AS m FROM r WHERE reason IN ('aligned', 'directed', 'undirected')),
            y AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM x), z AS (SELECT DISTINCT k, least(l[i], m[j])::INT AS a, greatest(l[i], m[j])::INT AS b FROM y WHERE (reason <> 'aligned' OR i = j) AND l[i] <> m[j])
            SELECT reason, coalesce(a, -1) AS a, coalesce(b, -1) AS b, count(*) AS events FROM r LEFT JOIN z USING (k) GROUP BY ALL"""),
        "A13_families": (families, sql(f"""SELECT signature, count(*) AS observations, count(*) FILTER (gold_label = 'positive') AS agreeing, count(DISTINCT sentence_id) AS sentences, string_agg(sentence_id, ';' ORDER BY rank) FILTER (rank <= 5) AS examples,
            round(count(*) FILTER (gold_label = 'positive') / count(*), 4) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seq) AS rank FROM
            (SELECT * FROM (SELECT *, predicate_lemma || '/' || {prep} AS signature FROM ledger) QUALIFY row_number() OVER (PARTITION BY signature, sentence_id, pair_a, pair_b ORDER BY seq) = 1)) GROUP BY signature""")),
        "A15_semantic_families": (semantic_families, sql(f"""SELECT predicate_lemma, count(DISTINCT s) AS families, count(*) AS observations, count(*) FILTER (gold_label = 'positive') AS agreeing, string_agg(DISTINCT s, ',' ORDER BY s) AS surfaces
            FROM (SELECT *, predicate_lemma || '/' || {prep} AS s FROM ledger) GROUP BY predicate_lemma""")),
        "E27_head_classes": (head_classes, sql("""SELECT coalesce(c, 'other') AS head_class, count(*) AS n FROM ledger LEFT JOIN (SELECT word, CASE WHEN bool_or(class = 'metric') THEN 'metric' WHEN bool_or(class = 'location') THEN 'location' ELSE 'process' END AS c
            FROM lex GROUP BY word) ON carrier_word = word GROUP BY ALL""", lex)),
        "T29_class_signatures": (class_signatures, sql("""SELECT signature, count(*) AS n FROM (SELECT corpus, predicate_lemma, shape, coalesce(string_agg(DISTINCT class, '+' ORDER BY class), 'none') AS signature
            FROM ledger LEFT JOIN lex ON carrier_word = word GROUP BY ALL) GROUP BY ALL""", lex)),
        "X_streamed_cells": (streamed, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS support, count(*) FILTER (value > 50) AS gold_positive FROM events GROUP BY ALL"),
    }
