"""Scalar expressions over texts and words, and their fingerprints."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# What joins an alias to its name, a phrase that may, and the white space before a new sentence.
ALIAS = r"^(?:also\s+)?(?:(?:known|called)\s+as|called|aka|alias|formerly)$"
IDENTITY = r"^\s*,\s*(?:a|an|the)\s+(?:[A-Za-z0-9_'\-/]+\s+){0,5}$"
BOUNDARY = r"(?<=[.!?])\s+(?=\S)"


def semantic_lemma(word: Column, lemma: Column) -> Column:
    """A lemma without the hyphen that it shares with its word, lower-cased; the word stands in for a missing lemma."""
    low = F.lower(F.coalesce(F.nullif(lemma, F.lit("")), word, F.lit("")))
    bare = F.substr(low, F.lit(2))
    cut = F.coalesce(word, F.lit("")).startswith("-") & low.startswith("-") & bare.rlike(r"\p{L}")
    return F.when(cut, bare).otherwise(low)


def is_alias_phrase(text: Column) -> Column:
    """Whether the words between two names say that one is an alias of the other; brackets, commas and semicolons don't count."""
    clean = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[(),;]", " ")), r"\s+", " "))
    return clean.rlike(ALIAS)


def is_identity_window(text: Column) -> Column:
    """Whether the text between two names may open an apposition."""
    return ~text.rlike(r"[();:]") & text.rlike(IDENTITY)


def sentence_boundaries(text: Column, around: int = 40) -> Column:
    """Where a sentence may begin within a text: an array of offset (characters before it), and what stands left and right of it.

    The text is cut once. One fold over the parts, from the left, adds up the offsets and keeps the last characters; one
    from the right keeps the first ones. So the work grows with the text's length."""
    pieces, gaps = F.split(text, BOUNDARY), F.regexp_extract_all(text, F.lit(BOUNDARY), 0)
    parts = F.zip_with(pieces, F.concat(gaps, F.array(F.lit(""))), lambda p, g: F.concat(p, g))  # each up to the next boundary
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    no_rows, no_texts = F.array().cast("array<struct<offset:int,left:string>>"), F.array().cast("array<string>")

    def onward(acc: Column, part: Column) -> Column:
        at, tail = acc["at"] + F.length(part), F.substring(F.concat(acc["tail"], part), -around, around)
        return F.struct(at.alias("at"), tail.alias("tail"), F.concat(acc["rows"], F.array(F.struct(at.alias("offset"), bare(tail).alias("left")))).alias("rows"))

    def backward(acc: Column, part: Column) -> Column:
        head = F.substring(F.concat(part, acc["head"]), 1, around)
        return F.struct(head.alias("head"), F.concat(acc["rows"], F.array(bare(head))).alias("rows"))

    n = F.size(gaps)
    left = F.aggregate(F.slice(parts, F.lit(1), n), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), no_rows.alias("rows")), onward, lambda acc: acc["rows"])
    right = F.aggregate(F.reverse(F.slice(parts, F.lit(2), n)), F.struct(F.lit("").alias("head"), no_texts.alias("rows")), backward, lambda acc: F.reverse(acc["rows"]))
    return F.zip_with(left, right, lambda a, r: F.struct(a["offset"].alias("offset"), a["left"].alias("left"), r.alias("right")))


def carrier_suspect(word: Column) -> Column:
    """Whether a carrier is hardly a noun: of one character, or without a letter."""
    clean = F.trim(F.coalesce(word, F.lit("")))
    return (F.length(clean) <= 1) | ~clean.rlike(r"\p{L}")


def corpus_of_path(path: Column, names: list[str]) -> Column:
    """The first of the names that is a part of a path, else the fourth part from its end, else `unknown`."""
    parts = F.split(path, "/")
    known = F.coalesce(*(F.when(F.array_contains(parts, n), n) for n in names), F.lit(None).cast("string"))
    return F.coalesce(known, F.when(F.size(parts) >= 4, F.element_at(parts, -4)), F.lit("unknown"))


def span_of(text: Column, tokens: Column, offsets: Column) -> Column:
    """The text from the first to the last of some tokens: by the tokens' offsets (array of start and end), else by the words that
    white space parts. Empty without tokens."""
    low, high = F.array_min(tokens), F.array_max(tokens)
    exact = F.substr(text, offsets[low]["start"] + 1, offsets[high]["end"] - offsets[low]["start"])
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rough = F.array_join(F.slice(words, low + 1, F.greatest(high - low + 1, F.lit(0))), " ")
    return F.when(F.size(tokens) <= 0, "").when((low >= 0) & (high < F.size(offsets)), exact).otherwise(rough)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and without white space, for fingerprints."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(value: object, length: int = 64) -> str:
    """sha256 of the canonical JSON, or its first characters."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def short_hash(value: Column, length: int = 8) -> Column:
    return F.left(F.md5(value.cast("binary")), F.lit(length))


def iso_time(at: datetime) -> str:
    return at.isoformat(timespec="seconds")


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
