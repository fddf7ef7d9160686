"""Versioned rules as tables: which are enabled, and what each decided where.

A rule's id is a dotted name with a version, such as `reference.pronoun_number_agreement@1`. Toggles are a table of prefix, exact and
enabled: an exact one concerns the rule of that very id, another the rules that have its prefix as their first dotted parts or as all. The
longest prefix that matches decides, an exact one before all; without any a rule is enabled.

An application is a decision of one rule (applied, blocked or not_applicable) with its stage, reason and evidence as canonical JSON. Applications
are rows while rules run; `appended` puts them, in their order, behind the trace that an event already has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPLICATION = "struct<rule_id:string,stage:string,decision:string,reason:string,evidence:string>"
# The form of an id and the decisions.
RULE_ID = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+@[1-9][0-9]*$"
DECISIONS = ("applied", "blocked", "not_applicable")


def prefixes(rule_id: Column) -> Column:
    """The dotted prefixes of an id, the id itself last."""
    parts = F.split(rule_id, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def with_enabled(rules: DataFrame, toggles: DataFrame, rule_id: str = "rule_id") -> DataFrame:
    """rules with enabled. Each rule meets its own prefixes by an equality join, however many toggles there are; trailing dots of a
    toggle's prefix don't count, and of toggles that contradict each other at one length a disabling one holds."""
    clean = F.regexp_replace(F.trim("prefix"), r"\.+$", "")
    known = toggles.select(F.when(F.col("exact"), F.col("prefix")).otherwise(clean).alias("_prefix"), F.col("exact").alias("_exact"), F.col("enabled").alias("_on")).filter("_prefix <> ''")
    known = known.groupBy("_prefix", "_exact").agg(F.bool_and("_on").alias("_on"))
    ids = rules.select(F.col(rule_id).alias("_id")).distinct()
    met = ids.select("_id", F.explode(prefixes(F.col("_id"))).alias("_prefix")).join(known, "_prefix").filter("NOT _exact OR _prefix = _id")
    chosen = met.groupBy("_id").agg(F.max_by("_on", F.struct("_exact", F.length("_prefix"))).alias("_on"))
    return rules.join(chosen, F.col(rule_id) == F.col("_id"), "left").withColumn("enabled", F.coalesce("_on", F.lit(True))).drop("_id", "_on")


def application(rule_id: Column, stage: Column, decision: Column, reason: Column, evidence: dict[str, Column]) -> Column:
    """A checked application; evidence keys go in alphabetical order, nulls are left out."""
    checked = F.when(~rule_id.rlike(RULE_ID), F.raise_error(F.concat(F.lit("no rule id: "), rule_id)).cast("string")).otherwise(rule_id)
    decided = F.when(~decision.isin(*DECISIONS), F.raise_error(F.concat(F.lit("no decision: "), decision)).cast("string")).otherwise(decision)
    staged = F.when(F.trim(stage) == "", F.raise_error(F.lit("a rule's application needs a stage")).cast("string")).otherwise(stage)
    said = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(evidence.items())))) if evidence else F.lit("{}")
    return F.struct(checked.alias("rule_id"), staged.alias("stage"), decided.alias("decision"), F.coalesce(reason, F.lit("")).alias("reason"), said.alias("evidence"))


def appended(rows: DataFrame, key: list[str], applications: DataFrame, order: list[str], trace: str = "trace", application: str = "application") -> DataFrame:
    """rows with the applications of their key behind the trace they have, in order."""
    new = applications.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(application).alias("_a")))).alias("_new"))
    old = F.coalesce(F.col(trace), F.array().cast(f"array<{APPLICATION}>")) if trace in rows.columns else F.array().cast(f"array<{APPLICATION}>")
    both = rows.withColumn(trace, old).join(new, key, "left")
    added = F.coalesce(F.transform("_new", lambda x: x["_a"]), F.array().cast(f"array<{APPLICATION}>"))
    return both.withColumn(trace, F.concat(trace, added)).drop("_new")


def run(rows: DataFrame, key: list[str], rules: list[tuple[str, str, Column, Column, dict[str, Column]]], toggles: DataFrame, trace: str = "trace") -> DataFrame:
    """Applies rules (id, stage, whether it concerns the row, reason for blocking or null, evidence) in their order to each row and appends
    the decisions: not_applicable rules leave nothing, a rule with a reason is blocked, others are applied. Disabled rules don't run.
    blocked is the first blocking rule's id; the rules after it don't run."""
    spark = rows.sparkSession
    on = {r.rule_id for r in with_enabled(spark.createDataFrame([(r[0],) for r in rules], "rule_id string"), toggles).filter("enabled").collect()}  # a row a rule
    empty = F.array().cast(f"array<{APPLICATION}>")
    out = rows.withColumn(trace, F.coalesce(F.col(trace), empty) if trace in rows.columns else empty).withColumn("blocked", F.lit(None).cast("string"))
    for rule_id, stage, concerns, reason, evidence in rules:
        if rule_id not in on:
            continue
        runs = F.col("blocked").isNull() & F.coalesce(concerns, F.lit(False))
        made = application(F.lit(rule_id), F.lit(stage), F.when(reason.isNotNull(), "blocked").otherwise("applied"), reason, evidence)
        out = out.withColumns({trace: F.when(runs, F.concat(trace, F.array(made))).otherwise(F.col(trace)), "blocked": F.when(runs & reason.isNotNull(), F.lit(rule_id)).otherwise(F.col("blocked"))})
    return out


def decisions(traced: DataFrame, trace: str = "trace") -> DataFrame:
    """How often each rule came to each decision, with its reason."""
    rows = traced.select(F.explode(trace).alias("a")).select("a.*")
    return rows.groupBy("rule_id", "stage", "decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
