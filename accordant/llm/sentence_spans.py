"""Substring deduplication by sliding sentence spans.

Sentences end after `.`, `!`, `?` or, so that the cut ends of a passage cost a clause rather than a long sentence, `,`, `;` or
`:` before white space, and at line ends. Every sentence begins a run and ends one: the fewest consecutive sentences that have
MIN_WORDS words or more, which are never more than MIN_WORDS, as each has a word. Every run is hashed (128 bits), and the hashes of all documents are joined. A span belongs
to the document of least doc_id that has it, and there to its first place; every other occurrence is a repeat, and the
sentences that a repeat covers are removed, with the white space after them. What stays keeps its bytes. A longer run
that repeats is covered by those within it, so one length a place is enough.

Repeats within a document are found where it is read. Between documents only hashes and places are shuffled, summed up
before the shuffle, so that a passage in a third of all documents costs a row a task; the occurrences come back by a
broadcast of the at most 1000 spans with over a thousandth of all occurrences, and by a shuffle join for the others.
The texts move once, to meet their removals.

A null text stays null and has no sentences; an empty one, or one of white space, stays as it is and has none. A text of any length
is cut whole, a batch at a time. Of equal rows of one doc_id, and of rows without an id, none cuts another: rows of one doc_id count
as one document in the test, and rows without an id as one that comes first. An empty table gives an empty table. Other columns pass
through; columns of the computed names (n_sentences, n_removed, _doc, _copy, _places) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MIN_WORDS = 16
#: Bytes of texts cut at a time; the arrays over them outweigh them many times.
CHUNK = 1 << 18
_ENDS = b".!?,;:"
_NO_ID = -(1 << 63)
_SPACE, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP[list(_ENDS)] = True


class Sentences:
    """The sentences of some texts (as bytes), in order: start and end in the joined bytes, the text each is of, and its words."""

    def __init__(self, texts: list[bytes]):
        self.raw = raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        step = np.diff(_SPACE[raw].astype(np.int8), prepend=np.int8(1 if len(raw) and _SPACE[raw[0]] else 0), append=np.int8(0))
        # Runs of white space [lo, hi), the line ends that join the texts among them.
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(lo) < len(hi):
            lo = np.concatenate([[0], lo])
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        cut = lines[hi] > lines[lo]
        cut |= (lo > 0) & _STOP[raw[np.maximum(lo, 1) - 1]]
        cut[:1] |= lo[:1] == 0
        begin, end = np.concatenate([[0], hi[cut]]), np.concatenate([lo[cut], [len(raw)]])
        real = end > begin
        self.start, self.end = begin[real], end[real]
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        # A word begins with the text or after white space.
        word = ~_SPACE[raw]
        word[1:] &= _SPACE[raw[:-1]]
        count = np.concatenate([[0], np.cumsum(word)])
        self.words = count[self.end] - count[self.start]

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First sentence and length of every run: of each sentence the fewest sentences from it on, and up to it, with enough words."""
        n = len(self.start)
        total = np.concatenate([[0], np.cumsum(self.words)])
        every = np.arange(n)
        on = np.searchsorted(total, total[:-1] + min_words)
        back = np.searchsorted(total, total[1:] - min_words, side="right") - 1
        low, high = self.first[self.doc], self.first[self.doc + 1]
        a, b, base = on <= high, back >= low, min_words + 1  # no run is longer than min_words
        both = np.unique(np.concatenate([every[a] * base + on[a] - every[a], back[b] * base + every[b] + 1 - back[b]]))
        return both // base, both % base

    def hashes(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each run."""
        out = np.zeros((2, len(at)), dtype=C.U64)
        for row, base in zip(out, (C._BASE, C.SECOND_BASE)):
            own = C.span_hashes(self.raw, self.start, self.end, base)
            for k in range(int(length.max()) if len(length) else 0):
                more = length > k
                row[more] = C.mix(row[more] * C.U64(base) + own[at[more] + k])
        return out

    def without(self, doc: int, gone: np.ndarray) -> bytes:
        """A text's bytes but for those sentences (flags by place), each with the white space up to the next sentence or the end."""
        a, b = self.bounds[doc], self.bounds[doc + 1] - 1
        start = self.start[self.first[doc] : self.first[doc + 1]]
        edge = np.concatenate([start, [b]])
        raw = self.raw[a:b]
        keep = np.ones(b - a, dtype=bool)
        for i in np.flatnonzero(gone):
            keep[edge[i] - a : edge[i + 1] - a] = False
        return raw[keep].tobytes()


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (by places) equal an earlier one of their text."""
    order = np.lexsort((h[1], h[0], doc))
    same = (np.diff(doc[order]) == 0) & (np.diff(h[0][order]) == 0) & (np.diff(h[1][order]) == 0)
    out = np.zeros(len(doc), dtype=bool)
    out[order[1:][same]] = True
    return out


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, copy, at (place and length, in 32 bits each) and hash of each span; own: it stands earlier in its document."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, texts in C.byte_chunks(b, CHUNK):
                cut = Sentences(texts)
                at, length = cut.runs(min_words)
                h, doc = cut.hashes(at, length), cut.doc[at]
                take = pa.array(doc + lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array((at - cut.first[doc]) << 32 | length, pa.int64()), pa.array(_again(doc, h), pa.bool_()), *(pa.array(x.view(np.int64)) for x in h)],
                    names=["doc", "copy", "at", "own", "h1", "h2"],
                )

    return docs.select("doc", "copy", "text").mapInArrow(batches, "doc long, copy long, at long, own boolean, h1 long, h2 long")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, copy and places, where the repeated spans of a text begin, with their lengths, of documents with doc, copy and text."""
    spans, _ = C.store(_spans(docs, min_words), "spans")
    firsts = spans.filter("NOT own")
    shared = firsts.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared, _ = C.store(shared, "shared-spans")
    key = ["h1", "h2"]
    later = C.join_on_unique(firsts, shared, key, "n", spans.count(), "inner").filter("doc <> first")
    where = ["doc", "copy", "at"]
    found = later.select(where).unionByName(spans.filter("own").select(where))
    return found.groupBy("doc", "copy").agg(F.collect_set("at").alias("places"))


def without_repeats(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """df with its column text cut by the repeated spans, and n_sentences and n_removed."""
    names = {"n_sentences", "n_removed", "_doc", "_copy", "_places"}
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    keyed = df.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_copy", F.coalesce(F.xxhash64("text"), F.lit(0)))
    places = repeats(keyed.select(F.col("_doc").alias("doc"), F.col("_copy").alias("copy"), "text"), min_words)
    both = keyed.join(places.toDF("_doc", "_copy", "_places"), ["_doc", "_copy"], "left").drop("_doc", "_copy")

    def batch(b: pa.RecordBatch) -> list:
        places, known = b.column(b.schema.get_field_index("_places")), b.column(b.schema.get_field_index("text")).is_valid().to_pylist()
        texts, count, removed = [], [], []
        for lo, raw in C.byte_chunks(b, CHUNK):
            cut = Sentences(raw)
            count += np.diff(cut.first).tolist()
            for i, text in enumerate(raw):
                found = places[lo + i].as_py()
                gone = np.zeros(count[lo + i], dtype=bool)
                for s in found or ():
                    gone[s >> 32 : (s >> 32) + (s & 0xFFFFFFFF)] = True
                texts.append((cut.without(i, gone) if found else text) if known[lo + i] else None)
                removed.append(int(gone.sum()))
        return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    return C.with_columns(both, batch, fields).drop("_places")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


@C.protected
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left go; n_chars is that of the new text."""
    columns = docs.columns
    out = without_repeats(docs).filter("n_removed < n_sentences OR n_sentences = 0")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in columns))


def oracle_sql() -> str:
    """The same by rows of sentences and windows over the texts of the runs. doc_id is unique in its table."""
    space, stop = r"[\x09-\x0D ]", f"[{_ENDS.decode()}]"
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s:.*?(?:{stop}{space}+|\n{space}*)|.+)') AS pieces FROM documents)
    , u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM d)
    , t AS (SELECT *, regexp_replace(piece, '^{space}+|{space}+$', '', 'g') AS s, len(regexp_extract_all(piece, '[^\x09-\x0D ]+')) AS w FROM u)
    , n AS (SELECT doc_id, k, piece, s, CASE WHEN w > 0 THEN sum((w > 0)::INT) OVER o END AS i, sum(w) OVER o AS upto, sum(w) OVER o - w AS before FROM t
            WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))
    , x AS (SELECT doc_id, i, s, upto, before FROM n WHERE i IS NOT NULL)
    , r AS (SELECT doc_id, i AS a, j AS b FROM (SELECT p.doc_id, p.i, min(q.i) AS j FROM x p JOIN x q ON p.doc_id = q.doc_id AND q.i BETWEEN p.i AND p.i + {MIN_WORDS - 1} AND q.upto - p.before >= {MIN_WORDS} GROUP BY ALL)
            UNION SELECT doc_id, j, i FROM (SELECT p.doc_id, p.i, max(q.i) AS j FROM x p JOIN x q ON p.doc_id = q.doc_id AND q.i BETWEEN p.i - {MIN_WORDS - 1} AND p.i AND p.upto - q.before >= {MIN_WORDS} GROUP BY ALL))
    , l AS (SELECT doc_id, list(s ORDER BY i) AS parts FROM x GROUP BY doc_id)
    , g AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY parts[a:b] ORDER BY doc_id, a) > 1 AS again FROM r JOIN l USING (doc_id))
    , c AS (SELECT DISTINCT doc_id, unnest(range(a::BIGINT, b::BIGINT + 1)) AS i FROM g WHERE again)
    , z AS (SELECT n.doc_id, count(n.i)::BIGINT AS n_sentences, count(c.i)::BIGINT AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN piece END, '' ORDER BY k) AS text
            FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.i = c.i GROUP BY n.doc_id)
    SELECT doc_id, CASE WHEN n_removed > 0 THEN coalesce(z.text, '') ELSE d.text END AS text, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed
    FROM documents d LEFT JOIN z USING (doc_id)"""
