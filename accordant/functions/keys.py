"""Keys, labels and other scalar expressions of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("positive", "negative")


def joined_key(parts: list[str]) -> Column:
    """Stripped parts joined by ` | `, null where any is empty (rows without a whole key drop out)."""
    clean = [F.trim(F.coalesce(p, F.lit(""))) for p in map(F.col, parts)]
    whole = reduce(lambda a, b: a & b, [c != "" for c in clean])
    return F.when(whole, F.concat_ws(" | ", *clean))


def plain_key(parts: list[str]) -> Column:
    """Parts as they are, empty ones kept, joined by `|`."""
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in map(F.col, parts)))


def document_id(sentence: Column, corpus: Column) -> Column:
    """The first two dotted parts of a sentence id, else the corpus."""
    parts = F.split(sentence, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), ".")).otherwise(corpus)


def or_mark(c: Column, mark: str = "_") -> Column:
    clean = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean == "", mark).otherwise(clean)


def canonical_key(evidence: Column, shape: Column, lemma: Column, case: Column, construction: Column) -> Column:
    return F.concat_ws("|", evidence, shape, or_mark(lemma), or_mark(case), construction)


def semantic_key(evidence: Column, shape: Column, lemma: Column, case: Column, construction: Column) -> Column:
    """Symmetric and noun-modifier shapes go by class and lemma alone."""
    return F.when(shape.isin("AB", "AB_NMOD", "AA"), F.concat_ws("|", evidence, or_mark(lemma))).otherwise(canonical_key(evidence, shape, lemma, case, construction))


def key_part(key: Column, i: int) -> Column:
    """Part i (from 0) of a `|` key; missing ones and `_` are empty."""
    part = F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit(""))
    return F.when(part == "_", "").otherwise(part)


def pair(a: Column, b: Column) -> Column:
    """An unordered pair; null for a pair of one with itself."""
    return F.when(a != b, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def either(a: Column, b: Column) -> Column:
    """An unordered pair, also of one with itself; null where an end is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def joined_unique(values: Column) -> Column:
    """Distinct values that aren't empty, sorted, joined by `|`."""
    return F.array_join(F.filter(F.sort_array(F.array_distinct(values)), lambda x: x.isNotNull() & (F.trim(x) != "")), "|")


def assertion(status: Column) -> Column:
    """Blank is asserted, what isn't known is uncertain."""
    clean = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(clean == "", "asserted").when(clean.isin("asserted", "negated", "uncertain", "hypothetical", "question", "purpose"), clean).otherwise("uncertain")


def review_signal(rate: Column, observed: Column, evaluable: Column) -> Column:
    """high and low agreement need 5 observations, 5 of them evaluable; from 3 evaluable on it is mixed."""
    enough = (observed >= 5) & (evaluable >= 5)
    return F.when(enough & (rate >= 0.80), "high").when(enough & (rate <= 0.20), "low").when(evaluable >= 3, "mixed").otherwise("insufficient")


def looks_complex(lemma: Column) -> Column:
    clean = F.lower(lemma)
    return (F.length(clean) >= 4) & (clean.endswith("mer") | clean.endswith("plex") | clean.endswith("gate")) & ~clean.endswith("monomer")
