"""Parsed sentences made of the driver's conversations, and queries over them, each with the SQL it is held against.

A turn is a sentence and its words are the nodes, whatever their number. Words get their annotation in blocks of eight from
five templates (a coordination, a copula, a reference, an apposition, a nominal event), chosen like all else by arithmetic on the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as R
from ..operators import rules
from ..scratch import by_sentence, dealt
from .fixtures import ledger, read, sql

#: template, slot, three lemmas to choose from ('' is the word's own), part of speech, dependency, slot of the head, names an entity in one of how many cases (0: never)
_TEMPLATES = """(0,0,'','','','PROPN','nsubj',4,1), (0,1,'and','and','and','CCONJ','cc',2,0), (0,2,'','','','PROPN','conj',0,1), (0,3,'','','','PROPN','conj',0,2),
 (0,4,'bind','bind','act','VERB','root',-1,0), (0,5,'they','it','which','PRON','obj',4,0), (0,6,'','','','NOUN','obl',4,0), (0,7,'these','these','the','DET','det',6,0),
 (1,0,'','','','PROPN','nsubj',3,1), (1,1,'be','be','be','AUX','cop',3,0), (1,2,'the','the','a','DET','det',3,0), (1,3,'kinase','kinase','receptor','NOUN','root',-1,0),
 (1,4,'','','','PROPN','conj',0,4), (1,5,'which','which','their','PRON','nsubj',6,0), (1,6,'','','','VERB','acl',3,0), (1,7,'.','.','.','PUNCT','punct',3,0),
 (2,0,'the','this','these','DET','det',1,0), (2,1,'kinase','kinase','receptor','NOUN','nsubj',2,0), (2,2,'act','bind','be','VERB','root',-1,0), (2,3,'','','','PROPN','obj',2,1),
 (2,4,'these','these','those','DET','det',6,0), (2,5,'two','three','2','NUM','nummod',6,0), (2,6,'protein','protein','factor','NOUN','obl',2,0), (2,7,'','','','PROPN','compound',6,4),
 (3,0,'','','','PROPN','root',-1,2), (3,1,'kinase','receptor','receptor','NOUN','appos',0,0), (3,2,'level','level','part','NOUN','obl',0,0), (3,3,'of','of','in','ADP','case',4,0),
 (3,4,'','','','PROPN','nmod:of',2,1), (3,5,'the','the','this','DET','det',6,0), (3,6,'proteins','receptor','kinase','NOUN','appos',2,0), (3,7,'it','them','those','PRON','obj',0,0),
 (4,0,'involve','form','show','VERB','root',-1,0), (4,1,'interaction','interaction','complex','NOUN','obj',0,0), (4,2,'of','with','by','ADP','case',3,0), (4,3,'','','','PROPN','nmod',1,1),
 (4,4,'with','to','with','ADP','case',5,0), (4,5,'','','','PROPN','nmod',1,1), (4,6,'','','','PROPN','conj',5,1), (4,7,'','','','PROPN','nsubj',0,1)"""
_NAMES = "template, slot, lemma0, lemma1, lemma2, pos, dep, head_slot, every"
ENTITY_NOMINALS, OWNER_HEADS = ["protein", "receptor", "kinase"], ["level", "activity"]

#: The same expressions for both engines, in the order in which they build on each other.
_STEPS = [
    {
        "v": "(conv_id * 7919 + turn * 104729 + cast(i as bigint) * 15485863 + length(surface) * 31) % 1000003",
        "template": "cast((conv_id * 31 + turn * 17 + floor(i / 8) * 13 + floor(i / 24)) % 5 as int)",
        "slot": "i % 8",
    },
    {"lemma": "case when lemma0 = '' then lower(surface) when v % 3 = 0 then lemma0 when v % 3 = 1 then lemma1 else lemma2 end"},
    {
        "sentence_id": "concat(cast(conv_id as string), '.', cast(turn as string))",
        "word": "case when lemma0 = '' then surface when v % 5 = 0 then concat(lemma, 's') else lemma end",
        "head_i": "case when head_slot < 0 then -1 else i - slot + head_slot end",
        "char_start": "i * 10",
        "char_end": "i * 10 + 9",
        "entity": "case when every > 0 and v % 7 > 0 and v % every = 0 then cast(floor(v / 7) % 6 as int) end",
    },
]



def nodes(turns: DataFrame) -> DataFrame:
    rows = turns.select("sentence_id", "conv_id", "turn", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \n]+"), 0)).alias("i", "surface"))
    rows = rows.withColumns({n: F.expr(x) for n, x in _STEPS[0].items()})
    rows = rows.join(F.broadcast(turns.sparkSession.sql(f"SELECT * FROM VALUES {_TEMPLATES} AS t({_NAMES})")), ["template", "slot"])  # 40 rows
    for step in (_STEPS[1], {n: x for n, x in _STEPS[2].items() if n != "sentence_id"}):
        rows = rows.withColumns({n: F.expr(x) for n, x in step.items()})
    direct = F.when(F.col("entity").isNotNull(), F.array("entity")).otherwise(F.array().cast("array<int>"))
    return rows.select("sentence_id", "conv_id", "turn", "i", "word", "lemma", "pos", "dep", "head_i", "char_start", "char_end", direct.alias("direct"), direct.alias("entities"), "v", "slot", "template")


#: mention -> (which pronouns have it, its cluster, its start, its end): a pronoun's antecedents stand in its block, in the one before or in the first.
_MENTIONS = [
    ("true", "i", "(i - slot - 8 * (v % 2)) * 10", "(i - slot - 8 * (v % 2) + v % 4) * 10 + 9"),
    ("true", "i", "char_start", "char_end"),
    ("v % 5 = 0", "i", "0", "9"),
    ("v % 6 = 0", "i + 1000000", "0", "29"),
    ("v % 6 = 0", "i + 1000000", "char_start", "char_end"),
]


def mentions(nodes: DataFrame) -> DataFrame:
    """Clusters of mentions: one or two for each pronoun."""
    some = nodes.filter("pos = 'PRON' OR (pos = 'DET' AND v % 9 = 0)")
    kind = "case when v % 11 = 0 then 'nominal' else 'pronoun' end"
    each = [F.expr(f"case when {which} then named_struct('cluster', cast({cluster} as long), 'mention', {k}, 'evidence_type', {kind}, 'start', cast({a} as long), 'end', cast({b} as long)) end") for k, (which, cluster, a, b) in enumerate(_MENTIONS)]
    return some.select("sentence_id", F.inline(F.array_compact(F.array(*each))))


def _parsed() -> str:
    as_sql = lambda step: ", ".join(f"{x} AS {n}" for n, x in step.items()).replace("as string", "as varchar")
    return ", ".join([
        f"templates AS (SELECT * FROM (VALUES {_TEMPLATES}) t({_NAMES}))",
        r"spread AS (SELECT conv_id, turn, unnest(w) AS surface, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \n]+') AS w FROM conversations))",
        f"step1 AS (SELECT *, {as_sql(_STEPS[0])} FROM spread)",
        f"step2 AS (SELECT *, {as_sql(_STEPS[1])} FROM step1 JOIN templates USING (template, slot))",
        f"nodes AS MATERIALIZED (SELECT *, CASE WHEN entity IS NULL THEN [] ELSE [entity] END AS direct FROM (SELECT *, {as_sql(_STEPS[2])} FROM step2))",
        "mentions AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT sentence_id, {c} AS cluster, {k} AS mention, CASE WHEN v % 11 = 0 THEN 'nominal' ELSE 'pronoun' END AS evidence_type, {a} AS s, {b} AS e FROM nodes WHERE (pos = 'PRON' OR (pos = 'DET' AND v % 9 = 0)) AND {w}" for k, (w, c, a, b) in enumerate(_MENTIONS)) + ")",
    ])


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of all turns, dealt by sentence. The turns are shuffled, once, and not their words."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "text").withColumn("sentence_id", F.expr(_STEPS[2]["sentence_id"]))
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sentence_id")
    return dealt(nodes(turns), "parsed", "sentence_id", already=True)


def resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = stored(spark, sf)
    return R.resolve(every.drop("v", "slot", "template", "conv_id", "turn"), dealt(mentions(every), "mentions", "sentence_id", already=True), ENTITY_NOMINALS, OWNER_HEADS)


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Every node that inherits, what, and from which node where it is one mention."""
    out, _ = resolved(spark, sf)
    return out.filter("kind IS NOT NULL").select("sentence_id", "i", "kind", F.array_join("entities", ",").alias("entities"), F.coalesce("reference_head", F.lit(-1)).alias("head"), F.coalesce(F.array_join("reference_nodes", ","), F.lit("")).alias("nodes"))


@by_sentence
def reference_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences' traces of the reference rules: how often each decision stands at each place of a trace."""
    out, applications = resolved(spark, sf)
    sentences = out.select("sentence_id").distinct()
    traced = rules.appended(sentences, ["sentence_id"], applications, ["step", "place", "i"])
    rows = traced.select(F.posexplode("trace").alias("spot", "a")).select("spot", "a.*")
    return rows.groupBy(F.least("spot", F.lit(9)).alias("spot"), "rule_id", "decision", "reason").agg(F.count(F.lit(1)).alias("n"))


#: Rule ids and toggles (prefix, exact, enabled) of the ledger's rows, the same expressions for both engines.
_RULE_ID = "concat('extraction.', channel, '.', evidence_class, '.', predicate_lemma, '@1')"
_TOGGLES = [
    ("concat('extraction.', channel, '.', evidence_class, '.')", False, False, "channel = 'state' and evidence_class = 'structural'"),
    ("concat('extraction.', channel)", False, False, "channel = 'clause'"),
    ("concat('extraction.', channel, '.', evidence_class)", False, True, "channel = 'clause' and evidence_class = 'relational'"),
    (_RULE_ID, True, False, "pair_a = 3 and predicate_lemma like '%7'"),
    (_RULE_ID, True, True, "pair_b = 1 and predicate_lemma like '%4'"),
    ("'extraction.event'", False, False, "true"),
]


def _toggles(rows: DataFrame) -> DataFrame:
    return rules.union([rows.filter(which).selectExpr(f"{prefix} AS prefix", f"{str(exact).lower()} AS exact", f"{str(on).lower()} AS enabled").distinct() for prefix, exact, on, which in _TOGGLES])


def enabled_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Each rule of the ledger's rows, how many rows it has, and whether it is enabled."""
    rows = ledger(spark, sf)
    firings = rows.groupBy(F.expr(_RULE_ID).alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    return rules.with_enabled(firings, _toggles(rows))


#: id, stage, rows it concerns, and where it blocks (None: never), why.
_RULES = [
    ("reference.same_place@1", "reference_resolution", "pair_a < 5", "pair_a = pair_b", "both ends are one"),
    ("extraction.clause.marker@2", "extraction", "channel = 'clause'", "case_marker = ''", "no case marker"),
    ("extraction.state.carrier@1", "extraction", "channel = 'state'", "carrier_word is null", "no carrier"),
    ("projection.asserted@1", "projection", "true", "assertion_status <> 'asserted'", "not asserted"),
    ("projection.released@1", "projection", "gold_label <> 'unlabeled'", None, ""),
]


def rule_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What each rule decided over the ledger's rows, where in their traces; the state rules are off by their namespace."""
    toggles = spark.createDataFrame([("extraction.state", False, False), ("extraction.cla", False, False)], "prefix string, exact boolean, enabled boolean")
    steps = [(i, s, F.expr(c), F.when(F.expr(b), r) if b else F.lit(None).cast("string"), {"place": F.col("pair_a"), "lemma": F.col("predicate_lemma")}) for i, s, c, b, r in _RULES]
    traced = rules.run(ledger(spark, sf), ["seq"], steps, toggles)
    out = traced.select("blocked", F.posexplode("trace").alias("spot", "a")).select("blocked", "spot", "a.*")
    return out.groupBy("spot", "rule_id", "stage", "decision", "reason", F.coalesce("blocked", F.lit("")).alias("blocked")).agg(F.count(F.lit(1)).alias("n"), F.min("evidence").alias("least_evidence"))


def _list(values: tuple) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _reference_ctes() -> list[str]:
    cardinal = "CASE key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.CARDINALS.items()) + " ELSE TRY_CAST(key AS INT) END"

    def coordination(name: str, table: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT sentence_id, h AS head, max(m) AS last, list_sort(list(DISTINCT x)) AS ents FROM (SELECT a.sentence_id, a.i AS h, b.i AS m, unnest(b.own) AS x FROM {table} a JOIN {table} b
            ON a.sentence_id = b.sentence_id AND (b.i = a.i OR (b.head_i = a.i AND b.dep = 'conj')) AND len(a.own) > 0 AND len(b.own) > 0) GROUP BY ALL HAVING count(DISTINCT m) > 1 AND count(DISTINCT x) = count(DISTINCT m))"""

    family = "(b.i = a.i OR (b.head_i = a.i AND b.dep = 'conj') OR (a.dep = 'conj' AND (b.i = a.head_i OR (b.dep = 'conj' AND b.head_i = a.head_i))))"
    return [
        "n0 AS MATERIALIZED (SELECT sentence_id, i, dep, head_i, pos, word, lemma, lower(lemma) AS key, char_start, char_end, direct AS ents, direct AS own FROM nodes)",
        coordination("g0", "n0"),
        "spans AS MATERIALIZED (SELECT m.sentence_id, m.cluster, m.mention, list(n.i ORDER BY n.i) AS spot, list_sort(list_distinct(flatten(list(n.ents)))) AS ents FROM mentions m JOIN n0 n ON n.sentence_id = m.sentence_id AND n.char_start >= m.s AND n.char_end <= m.e WHERE evidence_type = 'pronoun' GROUP BY ALL)",
        "ante AS (SELECT sentence_id, cluster, list_sort(list_distinct(flatten(list(ents)))) AS ents, count(*) AS k, any_value(spot) AS spot FROM spans WHERE len(ents) > 0 GROUP BY ALL)",
        f"""pron AS MATERIALIZED (SELECT p.*, len(ents) <= 1 OR key IN {_list(R.PLURAL)} OR (key = 'which' AND EXISTS (SELECT 1 FROM g0 WHERE g0.sentence_id = p.sentence_id AND g0.ents = p.ents)) AS fits FROM
            (SELECT DISTINCT s.sentence_id, s.cluster, n.i, n.key, a.ents, a.k, a.spot FROM spans s JOIN n0 n ON n.sentence_id = s.sentence_id AND list_contains(s.spot, n.i) JOIN ante a ON a.sentence_id = s.sentence_id AND a.cluster = s.cluster
            WHERE len(s.ents) = 0 AND (n.pos = 'PRON' OR (n.pos = 'DET' AND len(s.spot) = 1))) p)""",
        """tops AS (SELECT sentence_id, i, cluster, max(h) AS head, any_value(spot) AS spot FROM (SELECT p.sentence_id, p.i, p.cluster, p.spot, n.i AS h FROM pron p JOIN n0 n ON n.sentence_id = p.sentence_id AND list_contains(p.spot, n.i)
            WHERE fits AND k = 1 AND len(p.ents) = 1 AND (n.head_i = n.i OR NOT list_contains(p.spot, n.head_i))) GROUP BY ALL HAVING count(*) = 1)""",
        "got1 AS MATERIALIZED (SELECT sentence_id, i, arg_max(ents, cluster) AS ents FROM pron WHERE fits GROUP BY ALL)",
        "from1 AS (SELECT sentence_id, i, arg_max(head, cluster) AS head, arg_max(spot, cluster) AS spot FROM tops GROUP BY ALL)",
        "n1 AS MATERIALIZED (SELECT n.* EXCLUDE (ents, own), coalesce(g.ents, n.ents) AS ents, CASE WHEN len(n.own) > 0 THEN n.own ELSE coalesce(g.ents, []) END AS own, g.ents IS NOT NULL AS by1 FROM n0 n LEFT JOIN got1 g USING (sentence_id, i))",
        f"""fam AS MATERIALIZED (SELECT a.sentence_id, a.i, list_sort(list_distinct(flatten(list(b.own)))) AS ents FROM n1 a JOIN n1 b ON a.sentence_id = b.sentence_id AND {family} AND len(b.own) > 0 GROUP BY ALL)""",
        f"""told AS MATERIALIZED (
            SELECT h.sentence_id, h.key, h.i AS spot, f.ents FROM n1 h JOIN n1 s ON s.sentence_id = h.sentence_id AND s.head_i = h.i AND s.dep IN {_list(R.SUBJECTS)} JOIN fam f ON f.sentence_id = s.sentence_id AND f.i = s.i
                WHERE h.pos IN {_list(R.NOMINAL)} AND len(h.ents) = 0 AND EXISTS (SELECT 1 FROM n1 c WHERE c.sentence_id = h.sentence_id AND c.head_i = h.i AND c.dep = 'cop')
            UNION ALL SELECT sentence_id, key2, i2, e1 FROM app WHERE e1 IS NOT NULL AND e2 IS NULL AND pos2 IN {_list(R.NOMINAL)} UNION ALL SELECT sentence_id, key1, i1, e2 FROM app WHERE e2 IS NOT NULL AND e1 IS NULL AND pos1 IN {_list(R.NOMINAL)}
            UNION ALL SELECT a.sentence_id, a.key2, a.i2, list_sort(list_distinct(flatten(list(f.ents)))) FROM app a JOIN n1 o ON o.sentence_id = a.sentence_id AND o.head_i = a.i1 AND o.dep LIKE 'nmod%' JOIN fam f ON f.sentence_id = o.sentence_id AND f.i = o.i
                WHERE a.e1 IS NULL AND a.e2 IS NULL AND a.key1 IN {_list(tuple(OWNER_HEADS))} AND regexp_replace(a.key2, 's$', '') IN {_list(tuple(ENTITY_NOMINALS))} AND EXISTS (SELECT 1 FROM n1 c WHERE c.sentence_id = a.sentence_id AND c.head_i = a.i2 AND c.dep = 'det' AND c.key IN {_list(R.DETERMINERS)})
                AND EXISTS (SELECT 1 FROM n1 c WHERE c.sentence_id = o.sentence_id AND c.head_i = o.i AND c.dep = 'case' AND c.key = 'of') GROUP BY a.sentence_id, a.key2, a.i2)""".replace("told AS", "app AS (SELECT x.sentence_id, y.i AS i1, x.i AS i2, y.key AS key1, x.key AS key2, y.pos AS pos1, x.pos AS pos2, f.ents AS e1, g.ents AS e2 FROM n1 x JOIN n1 y ON y.sentence_id = x.sentence_id AND y.i = x.head_i LEFT JOIN fam f ON f.sentence_id = y.sentence_id AND f.i = y.i LEFT JOIN fam g ON g.sentence_id = x.sentence_id AND g.i = x.i WHERE x.dep = 'appos'), told AS", 1),
        "kids AS MATERIALIZED (SELECT sentence_id, head_i AS i, i AS child, dep, key, pos, len(own) > 0 AS named FROM n1 WHERE head_i >= 0)",
        f"""asks AS (SELECT n.sentence_id, n.i, n.key, EXISTS (SELECT 1 FROM kids k WHERE k.sentence_id = n.sentence_id AND k.i = n.i AND k.dep = 'det' AND k.key IN {_list(R.DEMONSTRATIVES)}) OR (lower(n.word) LIKE '%s' AND lower(n.word) <> lower(n.lemma)) AS several FROM n1 n
            WHERE n.pos IN {_list(R.NOMINAL)} AND len(n.ents) = 0 AND EXISTS (SELECT 1 FROM kids k WHERE k.sentence_id = n.sentence_id AND k.i = n.i AND k.dep = 'det' AND k.key IN {_list(R.DETERMINERS)})
            AND NOT EXISTS (SELECT 1 FROM kids k WHERE k.sentence_id = n.sentence_id AND k.i = n.i AND k.dep NOT IN ('det', 'case', 'punct', 'cc', 'mark') AND (k.named OR EXISTS (SELECT 1 FROM kids l WHERE l.sentence_id = k.sentence_id AND l.i = k.child AND l.named AND l.dep NOT IN ('case', 'punct', 'cc', 'mark'))))
            AND NOT (n.dep = 'conj' AND EXISTS (SELECT 1 FROM n1 p WHERE p.sentence_id = n.sentence_id AND p.i = n.head_i AND len(p.own) > 0)))""",
        "isa AS MATERIALIZED (SELECT a.sentence_id, a.i, count(DISTINCT t.ents) AS sets, bool_and(a.several OR len(t.ents) <= 1) AS allowed, any_value(t.ents) AS ents FROM asks a JOIN told t ON t.sentence_id = a.sentence_id AND t.key = a.key AND t.spot < a.i GROUP BY ALL)",
        "n2 AS MATERIALIZED (SELECT n.* EXCLUDE (ents, own), CASE WHEN s.i IS NOT NULL THEN s.ents ELSE n.ents END AS ents, CASE WHEN len(n.own) > 0 THEN n.own WHEN s.i IS NOT NULL THEN s.ents ELSE [] END AS own, s.i IS NOT NULL AS by2 FROM n1 n LEFT JOIN (SELECT * FROM isa WHERE sets = 1 AND allowed) s USING (sentence_id, i))",
        coordination("g2", "n2"),
        f"""shown AS (SELECT n.sentence_id, n.i, max(num) AS k FROM n2 n JOIN (SELECT sentence_id, i, dep = 'det' AND key IN {_list(R.DEMONSTRATIVES)} AS demo, CASE WHEN dep = 'nummod' OR pos = 'NUM' THEN {cardinal} END AS num FROM kids) k USING (sentence_id, i)
            WHERE n.pos IN {_list(R.NOMINAL)} AND len(n.ents) = 0 GROUP BY n.sentence_id, n.i HAVING bool_or(demo) AND count(num) = 1)""",
        "dem AS (SELECT s.sentence_id, s.i, arg_max(g.ents, g.last * 100000 - g.head) AS ents FROM shown s JOIN g2 g ON g.sentence_id = s.sentence_id AND g.last < s.i AND len(g.ents) = s.k GROUP BY ALL)",
    ]


def resolved_sql() -> str:
    return f"WITH {', '.join([_parsed(), *_reference_ctes()])} "


def catalogue() -> dict[str, tuple]:
    resolved = resolved_sql()
    rule_id = _RULE_ID
    toggles = "toggles AS (" + " UNION ".join(f"SELECT {p} AS prefix, {e} AS exact, {o} AS on_ FROM ledger WHERE {w}" for p, e, o, w in _TOGGLES) + ")"
    ran = " UNION ALL ".join(f"SELECT *, {k} AS k, '{i}' AS rule_id, '{s}' AS stage, {b or 'false'} AS stops, '{r}' AS reason FROM numbered WHERE {c}" for k, (i, s, c, b, r) in enumerate(_RULES) if ".state." not in i)
    said = f"""SELECT sentence_id, 1 AS step, cluster AS place, i, '{R.PRONOUN_RULE}' AS rule_id, fits AS ok, CASE WHEN fits THEN '{R.FITS}' ELSE '{R.NO_PLURAL}' END AS reason FROM pron
        UNION ALL SELECT sentence_id, 2, 0, i, '{R.IS_A_RULE}', sets = 1 AND allowed, CASE WHEN sets = 1 AND allowed THEN '{R.UNIQUE}' WHEN NOT allowed THEN '{R.CARDINALITY}' ELSE '{R.AMBIGUOUS}' END FROM isa"""
    return {
        "E3_E4_E5_J24_references": (references, resolved + f"""SELECT n.sentence_id, n.i::INT AS i, CASE WHEN by1 THEN '{R.KINDS["pronoun"]}' WHEN by2 THEN '{R.KINDS["is_a"]}' ELSE '{R.KINDS["group"]}' END AS kind, array_to_string(CASE WHEN by1 OR by2 THEN n.ents ELSE d.ents END, ',') AS entities,
            coalesce(CASE WHEN by1 THEN f.head END, -1)::INT AS head, coalesce(CASE WHEN by1 THEN array_to_string(f.spot, ',') END, '') AS nodes FROM n2 n LEFT JOIN dem d USING (sentence_id, i) LEFT JOIN from1 f USING (sentence_id, i) WHERE by1 OR by2 OR d.ents IS NOT NULL"""),
        "E3_E4_E31_reference_trace": (reference_trace, resolved + f"""SELECT least(spot, 9)::INT AS spot, rule_id, CASE WHEN ok THEN 'applied' ELSE 'blocked' END AS decision, reason, count(*) AS n FROM
            (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY step, place, i) - 1 AS spot FROM ({said})) GROUP BY ALL"""),
        "F15_E31_enabled_rules": (enabled_rules, sql(f"""SELECT rule_id, n, coalesce(on_, true) AS enabled FROM (SELECT {rule_id} AS rule_id, count(*) AS n FROM ledger GROUP BY ALL) r LEFT JOIN
            (SELECT id, arg_max(on_, exact::INT * 1000 + length(prefix)) AS on_ FROM (SELECT id, prefix, exact, bool_and(on_) AS on_ FROM (SELECT DISTINCT {rule_id} AS id FROM ledger) JOIN
            (SELECT CASE WHEN exact THEN prefix ELSE rtrim(prefix, '.') END AS prefix, exact, on_ FROM toggles) ON (exact AND prefix = id) OR (NOT exact AND (id = prefix OR starts_with(id, prefix || '.'))) GROUP BY ALL) GROUP BY id) ON id = rule_id""", toggles)),
        "E31_rule_decisions": (rule_decisions, sql(f"""SELECT (spot - 1)::INT AS spot, rule_id, stage, CASE WHEN k = blocked_k THEN 'blocked' ELSE 'applied' END AS decision, CASE WHEN k = blocked_k THEN reason ELSE '' END AS reason, coalesce(blocked, '') AS blocked, count(*) AS n,
            min('{{"lemma":"' || predicate_lemma || '","place":' || pair_a || '}}') AS least_evidence
            FROM (SELECT *, row_number() OVER (PARTITION BY seq, r ORDER BY k) AS spot FROM (SELECT *, min(CASE WHEN stops THEN k END) OVER (PARTITION BY seq, r) AS blocked_k, arg_min(rule_id, k) FILTER (stops) OVER (PARTITION BY seq, r) AS blocked FROM ({ran})) WHERE blocked_k IS NULL OR k <= blocked_k) GROUP BY ALL""", "numbered AS (SELECT *, row_number() OVER () AS r FROM ledger)")),
    }
