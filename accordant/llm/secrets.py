"""Secret scans: every rule in one pass of a combined, minimised deterministic automaton over the bytes.

The base kinds are `assign` (a name such as password or token, a sign and a value of 8 characters or more), `access` (AKIA and
capitals or digits, 16 characters or more) and `hex` (32 hexadecimal digits or more). Beyond them are `github`, `slack`, `google` and
`pem`, whose forms are public. Matches are leftmost and longest, without overlap within a kind; those that are too short
are dropped after they were matched, so what they cover is spent. A span is the whole match.

Nothing is shuffled; a batch is scanned a few hundred thousand bytes at a time, and what a task holds is some ten times that, but for longer texts, which
are held whole. A null text counts as empty. An empty one has no spans. A text of any length is read whole. Equal texts and repeated rows get equal results. An
empty table gives an empty table. Columns of the computed names (n_assign, n_access, n_hex, base_sha256, spans) are replaced, others pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C
from .automaton import Automaton, Rule, compile_rules, scan

# The expressions of the base kinds and the public forms of some keys.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, tail=True, either_case=True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]+", 32),
)
FURTHER = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
CHUNK = 1 << 19
FIELDS = [
    *(T.StructField(f"n_{r.name}", T.LongType()) for r in BASE),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def spans(a: Automaton, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Start and end in code points and the rule of each match, by text, in order."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    out: list[list] = [[] for _ in texts]
    points = None
    for r, start, end in scan(a, raw):
        if points is None:
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        k = int(np.searchsorted(bounds, start, side="right")) - 1
        out[k].append((int(points[start] - points[bounds[k]]), r, int(points[end] - points[bounds[k]])))
    return [sorted(x) for x in out]


def find_secrets(df: DataFrame, further: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """df with the columns of FIELDS for its column text. A rule may not match line ends, which part the texts."""
    automaton = compile_rules((*BASE, *further))
    if not automaton.safe[10]:
        raise ValueError("a rule matches line ends")
    names = [r.name for r in automaton.rules]

    def batch(b: pa.RecordBatch) -> list:
        found = [s for _, texts in C.byte_chunks(b, CHUNK) for s in spans(automaton, texts)]
        base = [[x for x in s if x[1] < len(BASE)] for s in found]
        say = lambda s: ",".join(f"{names[r]}:{start}:{end}" for start, r, end in s)
        counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(BASE))]
        return [*counts, pa.array([hashlib.sha256(say(s).encode()).hexdigest() for s in base], pa.string()), pa.array(map(say, found), pa.string())]

    return C.with_columns(df, batch, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def oracle_sql() -> str:
    """Each kind by the places between and the lengths of its expression's matches."""
    parts = []
    for k, r in enumerate((*BASE, *FURTHER)):
        pattern = ("(?i)" if r.either_case else "") + r.pattern
        pattern = pattern.replace("'", "''")
        least = f"len(tail) >= {r.least}" if r.tail else f"len(hit) >= {r.least}"
        parts.append(f"""SELECT doc_id, '{r.name}' AS kind, {k} AS rank, start, start + len(hit) AS stop FROM (
            SELECT doc_id, unnest(hits) AS hit, unnest(tails) AS tail, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(between[1:i::INT], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i::INT - 1], lambda x: len(x))), 0))) AS start
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {2 if r.tail else 0}) AS tails, regexp_split_to_array(text, '{pattern}') AS between FROM d)) WHERE {least}""")
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)
    say = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank){}, '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    , s AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, {counts}, sha256({say.format(f" FILTER (rank < {len(BASE)})")}) AS base_sha256, {say.format(" FILTER (kind IS NOT NULL)")} AS spans
    FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
