"""Review tables over an event store: sentences to look at, statements, events without pairs, examples, stores of patterns and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from ..scratch import kept
from .cells import first_of_group
from .ledgers import first_text, pairs_of_json

#: Lemmas that only name a relation's schema; such a relation has no trigger word of its own.
SCHEMA_LEMMAS = ("", "is-a", "has", "part-of", "identity")
#: Names under which a serialised argument lists its targets.
TARGET_LISTS = ("targets", "direct_targets", "propagated_targets", "protein_indices", "direct_protein_indices", "inherited_protein_indices")


def sentences_to_review(sentences: DataFrame, events: DataFrame, labels: tuple[str, ...], limit: int = 500) -> DataFrame:
    """Sentences of some labels with the patterns and details of their events, sorted and joined by commas: by the labels' order, then id.
    The limit is the report's length."""
    rank = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    asked = sentences.filter(F.col("label").isin(*labels)).withColumn("_rank", rank).orderBy("_rank", "sentence_id").limit(limit)
    # The report's sentences are known before what their events say is gathered: of the others nothing is.
    found = events.join(asked.select("sentence_id"), "sentence_id", "left_semi").groupBy("sentence_id").agg(
        *(F.array_join(F.array_sort(F.collect_set(n)), ",").alias(f"{n}s") for n in ("pattern_key", "event_detail"))
    )
    return asked.join(found, "sentence_id", "left").orderBy("_rank", "sentence_id").drop("_rank")


def extra_sentences(sentences: DataFrame, events: DataFrame, limit: int = 500) -> DataFrame:
    """Sentences with predicted pairs that aren't released, by id."""
    one = sentences.withColumn("_label", F.col("label")).withColumn("label", F.when(F.col("label").isin("too_many", "wrong_pairs"), "extra").otherwise("-"))
    return sentences_to_review(one, events, ("extra",), limit).withColumn("label", F.col("_label")).drop("_label")


def missing_sentences(sentences: DataFrame, events: DataFrame, limit: int = 500) -> DataFrame:
    """Sentences that miss released pairs, those without an event first."""
    return sentences_to_review(sentences, events, ("no_event", "too_few"), limit)


def relational(candidates: DataFrame) -> DataFrame:
    """Candidates that state a relation rather than an event."""
    return candidates.filter((F.lower(F.coalesce("projection_mode", F.lit(""))) == "relational") | (F.upper(F.coalesce("shape", F.lit(""))) == "RELATIONAL"))


def nominal_triggers(events: DataFrame, trigger: Column) -> tuple[DataFrame, DataFrame]:
    """The nominal of each relation statement, by event id, and by detail where a sentence's statements of one detail agree."""
    said = events.filter((F.col("semantic_event_class") == "relation_statement") | F.col("event_type").isin("RelationalStatement", "RELATION_STATEMENT"))
    said = said.withColumn("_t", trigger).filter("_t <> ''")
    by_event = said.groupBy("sentence_id", F.col("event_id").cast("string").alias("source_event_id")).agg(F.max_by("_t", "event_id").alias("_by_event"))
    by_detail = said.groupBy("sentence_id", F.coalesce("event_detail", F.lit("")).alias("event_detail")).agg(F.when(F.min("_t") == F.max("_t"), F.min("_t")).otherwise("").alias("_by_detail"))
    return by_event, by_detail


def counts_by(name: str) -> Column:
    """Counts of a column's values as value=n, sorted by value, over rows of a group that hold one value and its n."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "n"))), lambda x: F.concat_ws("=", x[name], x["n"])), ",")


def relational_statements(sentences: DataFrame, candidates: DataFrame, events: DataFrame, trigger: Column, min_count: int = 1, examples: int = 3) -> DataFrame:
    """Relational candidates by schema, detail and nominal trigger: each (sentence, pair) of a schema and detail once, how many of them are
    released, their share, counts by status, and the first examples. trigger: the nominal of a relation statement's event row."""
    by_event, by_detail = nominal_triggers(events, trigger)
    rows = relational(candidates).withColumn("pair", K.either(F.col("pair_a"), F.col("pair_b"))).filter("pair IS NOT NULL")
    schema = F.upper(first_text(F.coalesce("schema", F.lit("")), F.lit("RELATIONAL")))
    rows = rows.withColumns({"_schema": schema, "event_detail": first_text(F.coalesce("event_detail", F.lit("")), F.lit("unknown")), "source_event_id": F.coalesce(F.col("source_event_id").cast("string"), F.lit(""))})
    own = F.lower(F.trim(F.coalesce("predicate_lemma", F.lit(""))))
    own = F.when(own.isin(*SCHEMA_LEMMAS) | (own == F.lower("_schema")), "").otherwise(own)
    known = rows.join(by_event, ["sentence_id", "source_event_id"], "left").join(by_detail, ["sentence_id", "event_detail"], "left")
    known = known.withColumn("trigger", first_text(own, F.coalesce("_by_event", F.lit("")), F.coalesce("_by_detail", F.lit(""))))
    known = known.join(sentences.select("sentence_id", F.coalesce(pairs_of(F.col("gold_pairs")), F.array().cast("array<struct<a:int,b:int>>")).alias("_gold"), F.left("text", F.lit(500)).alias("text")), "sentence_id")
    once = first_of_group(known, ["sentence_id", "_schema", "event_detail", "pair"], ["pair_a", "pair_b", "id"], 1).drop("rank").withColumn("positive", F.array_contains("_gold", F.col("pair")))
    by = ["_schema", "event_detail", "trigger"]
    # Written once: the counts, the statuses and the examples read it, and would each join and shuffle everything anew.
    once = kept(once.select("sentence_id", "pair_a", "pair_b", *by, "assertion_status", "positive"), "statements")
    total = once.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("positive").alias("gold_positive")).filter(F.col("total") >= min_count)
    status = once.groupBy(*by, F.lower(first_text(F.coalesce("assertion_status", F.lit("")), F.lit("unknown"))).alias("status")).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(counts_by("status").alias("assertion_status"))
    few = first_of_group(once, by, ["sentence_id", "pair_a", "pair_b"], examples)
    shown = few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence_id"))), lambda x: x["sentence_id"]), ";").alias("examples"))
    out = total.join(status, by).join(shown, by).withColumns({
        "gold_negative": F.col("total") - F.col("gold_positive"),
        "agreement_with_gold": F.round(F.col("gold_positive") / F.col("total"), 4),
        "trigger_type": F.when(F.col("trigger") != "", "relational_nominal").otherwise("relation_schema"),
    })
    return out.withColumn("trigger", first_text(F.col("trigger"), F.col("_schema"))).withColumnRenamed("_schema", "schema").orderBy(F.desc("total"), "schema", "event_detail")


def argument_targets(arguments: Column) -> Column:
    """The target numbers anywhere within a serialised argument payload, distinct and sorted."""
    found = F.regexp_extract_all(arguments, F.lit(rf'"(?:{"|".join(TARGET_LISTS)})"\s*:\s*\[([0-9,\s]*)\]'), F.lit(1))
    numbers = F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("int"))))


def events_without_pairs(sentences: DataFrame, events: DataFrame, examples: int = 3) -> DataFrame:
    """Predicate events with a target that gave no pair, by trigger, pattern, detail and channel, most first."""
    bare = events.filter("semantic_event_class = 'predicate_event' AND coalesce(pred_pairs, '[]') = '[]'").withColumn("targets", argument_targets(F.col("arguments_json"))).filter(F.size("targets") > 0)
    rows = bare.join(sentences.select("sentence_id"), "sentence_id")
    named = {"trigger": ("predicate_lemma", "(no lexical trigger)"), "pattern_key": ("pattern_key", ""), "event_detail": ("event_detail", "unknown"), "realization_channel": ("realization_channel", "unknown")}
    rows = rows.select("sentence_id", "event_id", "targets", *(first_text(F.coalesce(c, F.lit("")), F.lit(d)).alias(n) for n, (c, d) in named.items()))
    few = first_of_group(rows, list(named), ["sentence_id", "event_id"], examples)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence_id", "targets"))), lambda x: F.concat(x["sentence_id"], F.lit(":"), F.array_join(x["targets"].cast("array<string>"), "+")))
    named_examples = few.groupBy(*named).agg(F.array_join(shown, ";").alias("examples"))
    return rows.groupBy(*named).agg(F.count(F.lit(1)).alias("event_occurrences")).join(named_examples, list(named)).orderBy(F.desc("event_occurrences"), "trigger", "event_detail")


def pattern_examples(sentences: DataFrame, candidates: DataFrame, limit: int = 3) -> DataFrame:
    """The first distinct (sentence, pair) of each pattern key, with their label and how the pair was reached."""
    rows = candidates.filter("coalesce(canonical_pattern_key, '') <> ''").withColumn("pair", K.either(F.col("pair_a"), F.col("pair_b"))).filter("pair IS NOT NULL")
    rows = rows.join(sentences.select("sentence_id", F.coalesce(pairs_of(F.col("gold_pairs")), F.array().cast("array<struct<a:int,b:int>>")).alias("_gold")), "sentence_id")
    once = first_of_group(rows, ["canonical_pattern_key", "sentence_id", "pair"], ["pair_a", "pair_b", "id"], 1).drop("rank")
    few = first_of_group(once, ["canonical_pattern_key"], ["sentence_id", "pair"], limit)
    ways = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{n}_propagated") != 0, n) for n in ("compound", "owner", "descriptor")))), "+")
    status = F.when(F.array_contains("_gold", F.col("pair")), "gold_positive").otherwise("gold_negative")
    return few.select("canonical_pattern_key", "rank", "sentence_id", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), status.alias("status"), F.coalesce("decision", F.lit("")).alias("decision"), ways.alias("propagation"))


def pattern_store(observations: DataFrame, examples: int = 3) -> DataFrame:
    """Observations of patterns (word, preposition, yield_type, construction, pred_pairs, gold_pairs, example, seq) summed up: predicted pairs where
    labels are released, those among them, their share, and the first distinct examples. Observations without a pair don't count."""
    pred, gold = pairs_of(F.col("pred_pairs")), pairs_of(F.col("gold_pairs"))
    lowered = lambda c: F.lower(F.trim(c))
    by = ["lemma", "preposition", "yield_type", "construction"]
    rows = observations.filter(F.size("pred_pairs") > 0).select(
        lowered("word").alias("lemma"), F.coalesce(lowered("preposition"), F.lit("")).alias("preposition"), F.upper(F.trim("yield_type")).alias("yield_type"),
        lowered(first_text(F.coalesce("construction", F.lit("")), F.lit("verbal"))).alias("construction"), F.when(gold.isNotNull(), F.size(pred)).otherwise(0).alias("t"), F.when(gold.isNotNull(), F.size(F.array_intersect(pred, gold))).otherwise(0).alias("c"), "example", "seq",
    )
    sums = rows.groupBy(*by).agg(F.sum("t").alias("total"), F.sum("c").alias("correct"))
    once = rows.filter("coalesce(example, '') <> ''").groupBy(*by, "example").agg(F.min("seq").alias("seq"))
    few = first_of_group(once, by, ["seq", "example"], examples).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]), ";").alias("examples"))
    return sums.join(few, by, "left").withColumns({"precision": F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 4), "examples": F.coalesce("examples", F.lit(""))})


def pairs_of(values: Column) -> Column:
    """Distinct pairs, each with the lesser end first; unlike `ledgers.pairs`, one with itself stays."""
    return F.array_distinct(F.transform(values, lambda p: F.struct(F.least(p["a"], p["b"]).alias("a"), F.greatest(p["a"], p["b"]).alias("b"))))


def merged_patterns(entries: DataFrame, order: str) -> DataFrame:
    """Entries of one pattern key as one: their correct and total summed up, the description of the last, the meaning key of the first."""
    described = ("lemma", "preposition", "yield_type", "shape", "evidence_class", "construction", "review_status", "source")
    out = entries.groupBy("pattern_key").agg(F.max_by("semantic_pattern_key", order).alias("semantic_pattern_key"), *(F.max_by(c, order).alias(c) for c in described), F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return out.withColumn("precision", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 4))


def word_stats(attributions: DataFrame) -> DataFrame:
    """Words by category. A trigger counts an evaluable occurrence right if its event gave a released pair; a carrier counts each propagated
    pair that is one. Beside them all occurrences, those that gave pairs or none, and those by an owner, a descriptor or a nested event."""
    on = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    evaluable, right = on("is_evaluable"), on("is_correct")
    out = attributions.groupBy(F.col("term").alias("word"), "category").agg(
        F.count_if(evaluable & right).alias("correct"), F.count_if(evaluable).alias("total"), F.count_if(evaluable & ~right).alias("fp_count"), F.count(F.lit(1)).alias("count_all"),
        F.count_if(on("gives_pairs")).alias("pair_contributing_occurrences"), F.count_if(~on("gives_pairs")).alias("nonprojecting_occurrences"),
        *(F.count_if(F.col("role").contains(n)).alias(f"{n}_occurrences") for n in ("owner", "descriptor", "nested")),
    )
    return out.withColumn("precision", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 4))


def word_reliability(stats: DataFrame, category: str | None = None, min_count: int = 1) -> DataFrame:
    """Words of a category (any, if none is named) with enough evaluable occurrences, their misses and Wilson bounds, best first."""
    rows = stats.filter(F.col("total") >= min_count)
    rows = rows.filter(F.col("category") == category) if category else rows
    low, high = S.wilson(F.col("correct"), F.col("total"))
    return rows.withColumns({"fp": F.col("total") - F.col("correct"), "ci_low": F.round(low, 4), "ci_high": F.round(high, 4)}).orderBy("category", F.desc("precision"), F.desc("total"), "word")


def event_type_precision(sentences: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs that each type of event gave, by whether they are released; sentences without released labels don't count."""
    given = events.select("sentence_id", F.coalesce(F.nullif("event_detail", F.lit("")), F.col("event_type")).alias("event_type"), F.explode(pairs_of(pairs_of_json(F.col("pred_pairs")))).alias("pair"))
    rows = given.join(sentences.filter("gold_pairs IS NOT NULL").select("sentence_id", pairs_of(F.col("gold_pairs")).alias("_gold")), "sentence_id")
    hit = F.array_contains("_gold", F.col("pair"))
    out = rows.groupBy("event_type").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("precision", F.round(F.col("tp") / F.col("total"), 4))


def same_event_pairs(members: Column) -> Column:
    """All unordered pairs of an event's distinct members."""
    m = F.array_sort(F.array_distinct(members))
    after = lambda x, i: F.transform(F.slice(m, i + 2, F.greatest(F.size(m) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(m, after))


def reasons(rows: DataFrame, counters: dict[str, Column], reason: str) -> DataFrame:
    """Counters of a run (rows for which each holds) and a histogram of its reasons, as one table of kind, name and n."""
    one = rows.agg(*(F.count_if(c).alias(n) for n, c in counters.items()))
    stacked = one.select(F.inline(F.array(*(F.struct(F.lit("counter").alias("kind"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in counters))))
    told = rows.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    return stacked.unionByName(told)
