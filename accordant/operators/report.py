"""Wording and pages for reports: phrases of patterns, trigger types, labels, and a page of evidence."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_part


def trigger_type(construction: Column, evidence: Column) -> Column:
    """verb, noun, state or relation, by the construction; what isn't known goes by the evidence class."""
    c = F.lower(F.coalesce(construction, F.lit("")))
    return (
        F.when(c.isin("verbal", "passive", "reciprocal"), "verb")
        .when(c.isin("nominal", "event_nominal"), "noun")
        .when(c.contains("state"), "state")
        .when(evidence == "relational", "relation")
        .otherwise("other")
    )


def readable(key: Column) -> Column:
    """A pattern key as a phrase: A verb (case) B, passive with `is ... by`, relations as `A is a trigger of B`."""
    shape, lemma, case, construction = (key_part(key, i) for i in (1, 2, 3, 4))
    marked = F.when(case != "", F.concat(F.lit(" "), case)).otherwise("")
    return (
        F.when(shape == "RELATIONAL", F.concat(F.lit("A ["), lemma, F.lit("] B")))
        .when(shape == "AA", F.concat(F.lit("A and B "), lemma))
        .when(construction == "passive", F.concat(F.lit("B is "), lemma, F.lit(" (passive)"), marked, F.lit(" A")))
        .otherwise(F.concat(F.lit("A "), lemma, marked, F.lit(" B")))
    )


def public_label(value: Column, names: dict[str, str]) -> Column:
    """The name of a value, else the value with spaces for underscores."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value) if names else F.lit(None).cast("string")
    return F.coalesce(known, F.replace(value, F.lit("_"), F.lit(" ")))


def trigger_words(cells: DataFrame, word: str, kind: str, count: str) -> DataFrame:
    """Each word with its total and its totals by kind, most first, as kind=n."""
    per = cells.groupBy(word, kind).agg(F.sum(count).alias("_n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col(kind).alias("k")))), lambda x: F.concat_ws("=", x["k"], -x["m"])), ", ")
    return per.groupBy(word).agg(F.sum("_n").alias("total"), kinds.alias("kinds"))


def evidence_page(rows: DataFrame, columns: list[str], title: str, limit: int = 250) -> str:
    """A page of the first rows, which the caller orders; the limit is the report's length."""
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if r[c] is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows.select(*columns).limit(limit).collect())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
