"""Quality rules by repetition coverage: which share of a text's characters lies inside duplicated word runs and lines.

Words are the runs of bytes other than space and 0x09-0x0D. A text is rejected when

* it has fewer than MIN_WORDS words, or over half of its words lie in a 3-word run found twice or more (the base rules);
* for some n of LIMITS, over LIMITS[n] percent of its word characters lie in an n-word run found twice or more;
* over LINE_CHARS percent of its word characters lie in lines equal to an earlier line, or over LINES percent of its
  lines with a word are such lines.

Runs are compared by 64-bit rolling hashes, all texts of an Arrow batch at once in numpy; nothing is shuffled.
A null text counts as having no words: it fails the base rules, as an empty one does. A text of any length is measured whole. Repeated rows each get their own result, equal
texts equal ones. An empty table gives an empty table. Columns of the computed names are replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MIN_WORDS = 50
REPEAT_WORDS = 50
#: Percent of word characters that may lie in duplicated runs of n words, the first of them included.
LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
LINE_CHARS, LINES = 20, 30

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    *(T.StructField(f"cover_{n}", T.LongType()) for n in LIMITS),
    T.StructField("dup_line_chars", T.LongType()),
    T.StructField("n_lines", T.LongType()),
]


def _repeated(doc: np.ndarray, h: np.ndarray, later: bool = False) -> np.ndarray:
    """Which of the hashes occur twice or more in their text; with later, which equal an earlier one."""
    key = C.mix(h ^ (doc.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable" if later else None)
    key = key[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = True
    if not later:
        out[order[:-1][same]] = True
    return out


def _covered(words: C.Words, n: int) -> np.ndarray:
    """Which words lie in a run of n words found twice or more in their text."""
    at, h = words.grams(n)
    edge = np.zeros(len(words.hash) + 1, dtype=np.int32)
    if len(at):
        found = at[_repeated(words.doc[at], h)]
        edge[found] += 1
        edge[found + n] -= 1  # a start occurs once, so plain indexing adds right
    return np.cumsum(edge[:-1]) > 0


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[cuts])


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of counts for each text, in the order of the long columns of FIELDS."""
    words = C.Words(texts, _IS_WORD)
    raw, cuts = words.raw, np.append(words.first, len(words.hash))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[words.end] - points[words.start]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw], dtype=np.int64)])
    word_chars = _sums(chars, cuts)

    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([words.bounds[:-1], breaks + 1]))
    ends = np.concatenate([starts[1:] - 1, [len(raw) - 1]])
    line_doc = np.searchsorted(words.bounds, starts, side="right") - 1
    lo, hi = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    real = hi > lo
    starts, ends, line_doc, lo, hi = starts[real], ends[real], line_doc[real], lo[real], hi[real]
    again = _repeated(line_doc, C.span_hashes(raw, starts, ends), later=True)
    by_word = np.concatenate([[0], np.cumsum(chars)])
    n = len(texts)
    columns = [
        words.count,
        word_chars,
        np.diff(symbols[words.bounds]),
        np.bincount(line_doc[again], minlength=n),
        _sums(_covered(words, 3), cuts),
        *(_sums(chars * _covered(words, k), cuts) for k in LIMITS),
        np.bincount(line_doc[again], weights=(by_word[hi] - by_word[lo])[again], minlength=n).astype(np.int64),
        np.bincount(line_doc, minlength=n),
    ]
    return np.stack([np.asarray(c, dtype=np.int64) for c in columns], axis=1).reshape(n, len(columns))


def _batch(batch: pa.RecordBatch) -> list:
    texts = [x or b"" for x in C.bytes_of(batch)]
    parts = [measure(texts[a:b]) for a, b in C.chunks([len(x) for x in texts])]
    m = np.concatenate(parts) if parts else np.zeros((0, 7 + len(LIMITS)), dtype=np.int64)
    words, chars, repeat, dup_lines = m[:, 0], m[:, 1], m[:, 4], m[:, 3]
    failed = (words < MIN_WORDS) | (100 * repeat > REPEAT_WORDS * words)
    bad = (100 * m[:, -2] > LINE_CHARS * chars) | (100 * dup_lines > LINES * m[:, -1])
    for k, limit in enumerate(LIMITS.values()):
        bad |= 100 * m[:, 5 + k] > limit * chars
    return [*(m[:, i].copy() for i in range(5)), failed, ~(failed | bad), *(m[:, i].copy() for i in range(5, m.shape[1]))]


def quality_rules(df: DataFrame) -> DataFrame:
    """df with the counts and verdicts of FIELDS for its column text; columns of those names are replaced."""
    return C.with_columns(df, _batch, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@C.protected
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    return quality_rules(docs).filter("kept").select(*(F.col(f"`{c}`") for c in columns))


_W = r"[^\x20\x09-\x0D]"


def oracle_sql() -> str:
    """The same counts by windows over unnested words."""
    sizes = [3, *LIMITS]
    grams = "\n".join(
        f""", g{n} AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c
            FROM (SELECT k, i, list_aggregate(words[i:i + {n - 1}], 'string_agg', ' ') AS g
                  FROM (SELECT k, words, unnest(range(1, len(words) - {n - 2})) AS i FROM d WHERE len(words) >= {n})))
        , c{n} AS (SELECT k, count(*) AS nw, sum(length(words[j])) AS nc
            FROM (SELECT DISTINCT k, unnest(range(i, i + {n})) AS j FROM g{n} WHERE c > 1) JOIN d USING (k) GROUP BY k)"""
        for n in sizes
    )
    cover = ", ".join(f"coalesce(c{n}.nc, 0)::BIGINT AS cover_{n}" for n in LIMITS)
    joins = " ".join(f"LEFT JOIN c{n} USING (k)" for n in sizes)
    bad = " OR ".join(f"100 * cover_{n} > {limit} * word_chars" for n, limit in LIMITS.items())
    return f"""
    WITH s AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents)
    , d AS (SELECT k, doc_id, text, regexp_extract_all(text, '{_W}+') AS words FROM s)
    , l AS (SELECT k, i, line, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS again
            FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM s)
            WHERE regexp_matches(line, '{_W}'))
    , ll AS (SELECT k, count(*) AS n_lines, count(*) FILTER (again) AS n_dup,
                coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (again), 0) AS dup_chars FROM l GROUP BY k)
    {grams}
    , m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c3.nw, 0)::BIGINT AS n_repeat_words,
        {cover}, coalesce(dup_chars, 0)::BIGINT AS dup_line_chars, coalesce(n_lines, 0)::BIGINT AS n_lines
        FROM d LEFT JOIN ll USING (k) {joins})
    , b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_WORDS} * n_words AS base_failed FROM m)
    SELECT *, NOT (base_failed OR {bad} OR 100 * dup_line_chars > {LINE_CHARS} * word_chars
        OR 100 * n_dup_lines > {LINES} * n_lines) AS kept FROM b"""
