"""Readers of labelled corpora: masked-sentence JSON, JSON lines, source XML, ledgers as CSV, lexicons."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<sentence:string,text:string,orig_sentence:string,proteins:array<string>,relations:map<string,string>>"
SENTENCES = "sentence_id string, sentence string, orig_sentence string, proteins array<string>, relations map<string,string>"
LEDGERS = {
    "pattern_observations": """corpus string, sentence_id string, candidate_id string, pair_a string, pair_b string, gold_label string, predicted_label string, application_status string,
        application_reason_code string, decision string, canonical_pattern_key string, semantic_pattern_key string, predicate_lemma string, shape string, construction string, case_marker string,
        realization_channel string, event_detail string, source_role string, target_role string, source_argument_role string, target_argument_role string, source_parser_dep string,
        target_parser_dep string, assertion_status string, projection_mode string, compound_propagated int, owner_propagated int, descriptor_propagated int, is_nominalized int, parser_source string""",
    "carrier_trigger_observations": "corpus string, sentence_id string, carrier_word string, pattern_key string, role string, is_evaluable int, gold_positive int, gold_label string",
    "lexical_observations": "corpus string, sentence_id string, term string, category string, role string, pattern_key string, event_detail string, is_evaluable int, gold_positive int, gold_label string",
    "corpus_summary": "corpus string, metric string, value string",
}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of corpus files: one JSON object each, either of entries by id or with them under `data`; a file that is neither is an
    error. Each file is one value; files are read in parallel."""
    text = spark.read.text(path, wholetext=True)
    entries = F.coalesce(
        F.from_json("value", f"struct<data:map<string,{ENTRY}>>")["data"],
        F.from_json("value", f"map<string,{ENTRY}>"),
        F.raise_error(F.concat(F.lit("no corpus object: "), F.left("value", F.lit(60)))).cast(f"map<string,{ENTRY}>"),
    )
    rows = text.select(F.explode(entries).alias("sentence_id", "e"))
    sentence = F.coalesce(F.nullif("e.sentence", F.lit("")), "e.text")
    return rows.select("sentence_id", sentence.alias("sentence"), F.coalesce("e.orig_sentence", sentence).alias("orig_sentence"), F.col("e.proteins").alias("proteins"), F.col("e.relations").alias("relations"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Sentences to predict, as JSON lines of id, text (or sentence) and proteins."""
    rows = spark.read.schema("id string, text string, sentence string, proteins array<string>").json(path)
    return rows.select(F.trim("id").alias("sentence_id"), F.coalesce(F.nullif("text", F.lit("")), "sentence").alias("sentence"), F.coalesce("proteins", F.array().cast("array<string>")).alias("proteins"))


def prediction_problems(rows: DataFrame) -> DataFrame:
    """sentence_id and problem of rows that can't be taken: no id, a repeated one, no text, no protein marker."""
    counts = rows.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.filter("n > 1 AND coalesce(sentence_id, '') <> ''").select("sentence_id", F.lit("repeated id").alias("problem"))
    text = F.coalesce("sentence", F.lit(""))
    own = F.when(F.coalesce("sentence_id", F.lit("")) == "", "no id").when(text == "", "no text").when(~text.rlike(r"PROTEIN\d+"), "no marker")
    return rows.select("sentence_id", own.alias("problem")).filter("problem IS NOT NULL").unionByName(repeated)


def gold_pairs(relations: Column, with_missing: bool = False) -> Column:
    """Sorted distinct pairs (a, b), a <= b, of a map from "[i, j]" to a label; what is no pair of numbers from 0 on is left out, and labels that begin with MISSING_LABEL unless with_missing."""
    kept = relations if with_missing else F.map_filter(relations, lambda k, v: ~F.coalesce(v.startswith("MISSING_LABEL"), F.lit(False)))
    ends = F.transform(F.map_keys(kept), lambda k: F.from_json(k, "array<int>"))
    whole = F.filter(ends, lambda e: (F.size(e) >= 2) & F.coalesce((F.get(e, F.lit(0)) >= 0) & (F.get(e, F.lit(1)) >= 0), F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda e: F.struct(F.array_min(F.slice(e, 1, 2)).alias("a"), F.array_max(F.slice(e, 1, 2)).alias("b")))))


def listed_pairs(relations: Column) -> Column:
    """The same of relations that a text lists, as objects (protein_a and protein_b, or arg1 and arg2) or as two-number lists."""
    objects = F.from_json(relations, "array<struct<protein_a:int,protein_b:int,arg1:int,arg2:int>>")
    named = F.transform(objects, lambda o: F.array(F.coalesce(o["protein_a"], o["arg1"]), F.coalesce(o["protein_b"], o["arg2"])))
    ends = F.when(F.trim(relations).rlike(r"^\[\s*\{"), named).otherwise(F.from_json(relations, "array<array<int>>"))
    whole = F.filter(ends, lambda e: (F.size(e) == 2) & F.coalesce((e[0] >= 0) & (e[1] >= 0), F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda e: F.struct(F.array_min(e).alias("a"), F.array_max(e).alias("b")))))


def metadata(sentences: DataFrame) -> DataFrame:
    """Sentences, those with a relation, possible pairs and relations of a corpus."""
    n, r = F.size("proteins"), F.size(F.coalesce("relations", F.create_map().cast("map<string,string>")))
    return sentences.agg(
        F.count(F.lit(1)).alias("total_sentences"), F.count_if(r > 0).alias("sentences_with_relation"),
        F.sum((n * (n - 1) / 2).cast("long")).alias("total_pairs"), F.sum(r).alias("pairs_with_relation"),
    )


def mask_problems(sentences: DataFrame) -> DataFrame:
    """sentence_id with the markers that are missing and those that are too many, and relations out of range."""
    found = F.transform(F.regexp_extract_all("sentence", F.lit(r"PROTEIN(\d+)"), 1), lambda x: x.cast("int"))
    n = F.size("proteins")
    wanted = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    beyond = F.filter(gold_pairs(F.col("relations"), True), lambda p: p["b"] >= F.size("proteins"))
    rows = sentences.select("sentence_id", F.array_sort(F.array_except(wanted, found)).alias("missing"), F.array_sort(F.array_except(found, wanted)).alias("extra"), beyond.alias("beyond"))
    return rows.filter("size(missing) + size(extra) + size(beyond) > 0")


def read_ledger(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ledger as CSV; a missing one has no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGERS[name]).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGERS[name])


def with_columns_or(df: DataFrame, defaults: dict) -> DataFrame:
    """df with those columns that it lacks, as literals."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c.lower() not in have})


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list, one a line, lower-cased; empty lines and # comments are left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> '' AND NOT startswith(word, '#')").distinct()


# ---- source XML -----------------------------------------------------------------------------


def read_sentence_xml(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of source XML with their entities and interactions, in the order of the file."""
    entity = "array<struct<_id:string,_text:string,_charOffset:string>>"
    interaction = "array<struct<_e1:string,_e2:string,_type:string>>"
    rows = spark.read.format("xml").option("rowTag", "sentence").schema(f"_id string, _text string, entity {entity}, interaction {interaction}").load(path)
    return rows.select(F.col("_id").alias("sentence_id"), F.col("_text").alias("text"), F.coalesce("entity", F.array().cast(entity)).alias("entities"), F.coalesce("interaction", F.array().cast(interaction)).alias("interactions"))


def offsets(raw: str) -> list[tuple[int, int]]:
    """Half-open spans of "a-b,c-d"."""
    spans = [tuple(int(x) for x in part.split("-", 1)) for part in (raw or "").split(",") if part.strip()]
    if not spans or any(len(s) != 2 or s[0] < 0 or s[1] < s[0] for s in spans):
        raise ValueError(f"no character range: {raw!r}")
    return spans


def replaced_spans(spans: list[list[tuple[int, int]]]) -> list[tuple[int, int, list[int]]]:
    """The stretches of text that markers replace: start, end, and the entities of each, in order.

    Entities whose spans overlap, directly or by others, are replaced as one, from their least start to their greatest end.
    A lone entity of several spans that has another within its gaps is replaced at its first span only. Stretches that still
    overlap go together where one has several entities; two lone ones that overlap are an error."""
    events = sorted((s, e, i) for i, own in enumerate(spans) for s, e in own if e > s)
    owner = list(range(len(spans)))

    def top(i: int) -> int:
        return i if owner[i] == i else top(owner[i])

    open_: list[tuple[int, int]] = []  # (end, entity) of spans that reach on
    for s, e, i in events:
        open_ = [(end, j) for end, j in open_ if end > s]
        for _, j in open_:
            owner[max(top(i), top(j))] = min(top(i), top(j))
        open_.append((e, i))
    groups: dict[int, list[int]] = {}
    for i in range(len(spans)):
        groups.setdefault(top(i), []).append(i)

    def stretch(members: list[int]) -> tuple[int, int, list[int]]:
        members = sorted(members, key=lambda i: (min(spans[i])[0], i))
        every = [x for i in members for x in spans[i]]
        low, high = min(s for s, _ in every), max(e for _, e in every)
        if len(members) == 1 and len(every) > 1:
            within = any(low <= s and e <= high for j, own in enumerate(spans) if j != members[0] for s, e in own)
            if within:
                low, high = min(every)
        return low, high, members

    out: list[tuple[int, int, list[int]]] = []
    for low, high, members in sorted(map(stretch, groups.values()), key=lambda g: (g[0], g[1], g[2][0])):
        if out and low < out[-1][1]:
            if len(members) == 1 and len(out[-1][2]) == 1:
                raise ValueError("entities overlap by their covers alone")
            out[-1] = stretch(out[-1][2] + members)
        else:
            out.append((low, high, members))
    return out


def masked(text: str, entities: list[dict], interactions: list[dict]) -> tuple[str, list[str], dict[str, str]]:
    """The text with PROTEINn for its entities, their texts, and the relations by pair of numbers."""
    out, proteins, number, at = [], [], {}, 0
    for low, high, members in replaced_spans([offsets(e["_charOffset"]) for e in entities]):
        marks = []
        for i in members:
            number[entities[i]["_id"]] = len(proteins)
            marks.append(f"PROTEIN{len(proteins)}")
            proteins.append(entities[i]["_text"] or "")
        before = " " if low and text[low - 1].isalnum() else ""
        after = " " if text[high : high + 1].isalnum() else ""
        out += [text[at:low], before, " ".join(marks), after]
        at = high
    relations: dict[tuple[int, int], str] = {}
    for x in interactions:
        if x["_e1"] not in number or x["_e2"] not in number:
            raise ValueError(f"an interaction of an unknown entity: {x['_e1']}, {x['_e2']}")
        a, b = sorted((number[x["_e1"]], number[x["_e2"]]))
        if a != b:
            relations[a, b] = x["_type"] or "PPI"
    return "".join([*out, text[at:]]), proteins, {json.dumps(list(k)): relations[k] for k in sorted(relations)}


def mask_sentences(sentences: DataFrame) -> DataFrame:
    """Corpus sentences from source sentences. Each is masked by itself, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *masked(t, list(e), list(x)), t) for i, t, e, x in zip(b["sentence_id"], b["text"], b["entities"], b["interactions"])]
            yield pd.DataFrame([(i, m, t, p, r) for i, m, p, r, t in rows], columns=["sentence_id", "sentence", "orig_sentence", "proteins", "relations"])

    return sentences.select("sentence_id", "text", "entities", "interactions").mapInPandas(run, SENTENCES)


def write_corpus(sentences: DataFrame, path: str) -> None:
    """Sentences as JSON lines, a sentence each."""
    sentences.write.json(path)
