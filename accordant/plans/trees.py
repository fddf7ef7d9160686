"""Queries over the trees of the parsed sentences, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees as X
from ..scratch import by_sentence, dealt
from . import parsed as P


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return P.stored(spark, sf)


@by_sentence
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Verbs and nouns with how many nodes and entities stand below them, and where the walk has them."""
    nodes = _nodes(spark, sf)
    index = dealt(X.tree_index(nodes), "index", "sentence_id", already=True)
    heads = nodes.filter("pos IN ('VERB', 'NOUN', 'PROPN')").select("sentence_id", F.col("i").alias("head"))
    held = X.below(index, heads, strict=False).join(nodes.select("sentence_id", "i", "entities"), ["sentence_id", "i"])
    sums = held.groupBy("sentence_id", "head").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("entities")).alias("named"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))), ",").alias("entities"))
    return sums.join(index.select("sentence_id", F.col("i").alias("head"), "pre", "depth"), ["sentence_id", "head"])


@by_sentence
def groups(spark: SparkSession, sf: str) -> DataFrame:
    out = X.coordination_groups(_nodes(spark, sf))
    said = lambda m: F.concat_ws(":", m["node"].cast("string"), F.array_join(m["head_entities"], ","), F.array_join(m["modifier_entities"], ","))
    return out.select("sentence_id", "root", "alternative", F.array_join(F.transform("members", said), ";").alias("members"))


@by_sentence
def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each sentence's outline."""
    nodes = _nodes(spark, sf)
    return X.outline(nodes, X.tree_index(nodes), "lemma").select("sentence_id", F.length("tree").alias("chars"), F.md5(F.col("tree").cast("binary")).alias("digest"))


@by_sentence
def reduced(spark: SparkSession, sf: str) -> DataFrame:
    """The reduced tree of each sentence as JSON."""
    return X.reduced_trees(_nodes(spark, sf).withColumn("word", F.regexp_replace("lemma", '["\\\\\\\\]', "")))


def catalogue() -> dict[str, tuple]:
    base = P.resolved_sql().split(", mentions AS", 1)[0]

    def walk(name: str, table: str) -> str:
        return f"""{name}(sentence_id, i, path) AS (SELECT t.sentence_id, t.i, [t.i] FROM {table} t WHERE NOT EXISTS (SELECT 1 FROM {table} h WHERE h.sentence_id = t.sentence_id AND h.i = t.head_i)
            UNION ALL SELECT t.sentence_id, t.i, list_append(w.path, t.i) FROM {name} w JOIN {table} t ON t.sentence_id = w.sentence_id AND t.head_i = w.i)"""

    recursive = base.replace("WITH ", "WITH RECURSIVE ", 1)
    placed = "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY path) - 1 AS pre, len(path) - 1 AS depth FROM walk)"
    conj = "conjs AS (SELECT sentence_id, i, CASE WHEN dep = 'conj' THEN head_i ELSE -1 END AS head_i FROM nodes)"
    function = "(" + ", ".join(f"'{x}'" for x in X.FUNCTION) + ")"
    return {
        "E17_ranges": (ranges, recursive + f""", {walk("walk", "nodes")}, {placed} SELECT h.sentence_id, h.i AS head, count(*) AS nodes, count(n.entity) AS named, coalesce(string_agg(DISTINCT n.entity::VARCHAR, ',' ORDER BY n.entity::VARCHAR), '') AS entities, p.pre::INT AS pre, p.depth::INT AS depth
            FROM nodes h JOIN placed p ON p.sentence_id = h.sentence_id AND p.i = h.i JOIN placed q ON q.sentence_id = h.sentence_id AND list_contains(q.path, h.i) JOIN nodes n ON n.sentence_id = q.sentence_id AND n.i = q.i WHERE h.pos IN ('VERB', 'NOUN', 'PROPN') GROUP BY ALL"""),
        "E17_groups": (groups, recursive + f""", {conj}, {walk("chain", "conjs")}, m AS (SELECT c.sentence_id, c.path[1] AS root, c.i, CASE WHEN n.entity IS NULL THEN '' ELSE n.entity::VARCHAR END AS own, coalesce((SELECT string_agg(DISTINCT k.entity::VARCHAR, ',' ORDER BY k.entity::VARCHAR) FROM nodes k WHERE k.sentence_id = c.sentence_id AND k.head_i = c.i AND k.dep IN ('compound', 'appos', 'amod') AND k.entity IS NOT NULL AND (n.entity IS NULL OR k.entity <> n.entity)), '') AS more,
            EXISTS (SELECT 1 FROM nodes k WHERE k.sentence_id = c.sentence_id AND k.head_i = c.i AND k.dep = 'cc' AND lower(k.lemma) IN ('or', 'nor', 'either')) AS alt FROM chain c JOIN nodes n ON n.sentence_id = c.sentence_id AND n.i = c.i)
            SELECT sentence_id, root, bool_or(alt) AS alternative, string_agg(i || ':' || own || ':' || more, ';' ORDER BY i) AS members FROM m GROUP BY ALL HAVING count(*) > 1"""),
        "P22_outlines": (outlines, recursive + f""", {walk("walk", "nodes")}, {placed} SELECT sentence_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT sentence_id, string_agg(repeat('  ', depth) || lemma, chr(10) ORDER BY pre) AS t FROM placed JOIN nodes USING (sentence_id, i) GROUP BY sentence_id)"""),
        "P22_reduced_trees": (reduced, recursive + f""", {walk("walk", "nodes")}, kept AS MATERIALIZED (SELECT n.sentence_id, n.i, n.head_i, n.dep, regexp_replace(n.lemma, '["\\\\]', '', 'g') AS word FROM walk w JOIN nodes n USING (sentence_id, i) WHERE NOT EXISTS (SELECT 1 FROM nodes g WHERE g.sentence_id = n.sentence_id AND list_contains(w.path, g.i) AND g.dep IN {function})),
            conjs AS (SELECT sentence_id, i, CASE WHEN dep = 'conj' THEN head_i ELSE -1 END AS head_i FROM kept), {walk("chain", "conjs")}, roots AS MATERIALIZED (SELECT sentence_id, i, path[1] AS root FROM chain),
            small AS MATERIALIZED (SELECT k.sentence_id, k.i, coalesce(h.root, -1) AS head_i, k.dep, k.word, m.members FROM kept k JOIN (SELECT sentence_id, root AS i, list(i ORDER BY i) AS members FROM roots GROUP BY ALL) m USING (sentence_id, i) LEFT JOIN roots h ON h.sentence_id = k.sentence_id AND h.i = k.head_i),
            {walk("tops", "small")}, spots AS (SELECT *, len(path) AS depth, row_number() OVER (PARTITION BY sentence_id ORDER BY path) AS pre, lead(len(path)) OVER (PARTITION BY sentence_id ORDER BY path) AS following FROM tops JOIN small USING (sentence_id, i))
            SELECT sentence_id, '[' || string_agg('{{"id":' || i || ',"kind":"' || CASE WHEN len(members) > 1 THEN 'group' ELSE 'lexical' END || '","role":"' || dep || '","text":"' || word || '","members":[' || array_to_string(members, ',') || '],"children":[' || repeat(']}}', greatest(depth - coalesce(following, 1) + 1, 0)::BIGINT) || CASE WHEN following <= depth THEN ',' ELSE '' END, '' ORDER BY pre) || ']' AS tree
            FROM spots GROUP BY sentence_id"""),
    }
