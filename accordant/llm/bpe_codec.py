"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database a partition.

The distinct pre-tokens of a batch become token-position rows. A recursive query joins each adjacent pair of tokens to
the merge table, finds every word's pair of least rank (the leftmost of equals) and contracts it, until no word has a
pair left. A pre-token that is itself in the vocabulary takes its id at once. Decoding joins id rows to the vocabulary and
aggregates their bytes in order: the ids that a unit of text was given are what its bytes are decoded from.

The rows of a recursion grow with a word's length times its merges, so a word of over SEGMENT bytes is contracted in segments of that
length, and its seams are then proved. A sequence of tokens is the encoding of its bytes if and only if every two
neighbours are that of theirs: the first merge across a border between two tokens would also be made in the two alone, as the order of
merges in them doesn't depend on what stands around. Where two neighbours at a seam aren't, a window around it is contracted anew, and
its own ends are seams; windows double until all seams hold. So a word of any length gets the library's ids, in bounded memory.

Words are kept in a cache of CACHE entries a partition that empties when it is full. A null or empty text has no ids, and decodes to no
bytes; an empty table gives an empty table. Repeated rows each get their result, equal texts equal ones; columns of the computed names
are replaced, others pass through. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .pretokens import Units, compiled

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE = 300_000
#: Most bytes that one word of the recursion has, and tokens on each side of a seam that are first contracted anew.
SEGMENT, WINDOW = 64, 4

FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]

#: Token rows (word, place, token, the token after it and its place) of words, contracted to the fixpoint. A round makes the rows of
#: the words that had a pair to merge: the pair's left row takes the merged token, its right row goes, and the neighbours' links
#: follow. A word's last round is its result. A pair's rank and place are one number, so that the least is the leftmost of least rank.
ENCODE = """
WITH RECURSIVE step(word, pos, tok, next_tok, next_pos, round) AS (
    SELECT word, pos, tok, lead(tok) OVER w, lead(pos) OVER w, 0 FROM symbols WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT s.word, s.pos, CASE WHEN s.pos = at_pos THEN new_tok ELSE s.tok END,
        CASE WHEN s.pos = at_pos THEN after_tok WHEN s.next_pos = at_pos THEN new_tok ELSE s.next_tok END,
        CASE WHEN s.pos = at_pos THEN after_pos ELSE s.next_pos END, s.round + 1
    FROM step s JOIN (
        SELECT best.word, l.pos AS at_pos, (best.pair >> 32)::INTEGER AS new_tok, r.pos AS gone, r.next_tok AS after_tok, r.next_pos AS after_pos
        FROM (SELECT word, min(m.rank::BIGINT << 32 | pos) AS pair FROM step JOIN merges m ON tok = m.left_id AND next_tok = m.right_id GROUP BY word) best
        JOIN step l ON l.word = best.word AND l.pos = best.pair & 4294967295
        JOIN step r ON r.word = best.word AND r.pos = l.next_pos
    ) c ON s.word = c.word AND s.pos <> c.gone
), last AS (
    SELECT word, max(round) AS round FROM step GROUP BY word
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step SEMI JOIN last USING (word, round) GROUP BY word
"""

#: The bytes of runs of ids (run, pos, id).
DECODE = "SELECT run, unhex(string_agg(hex, '' ORDER BY pos)) AS raw FROM ids JOIN vocabulary USING (id) GROUP BY run"


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[pa.Table, pa.Table]:
    """The vocabulary and the merge table: every pair of tokens whose bytes together are a token, which is the rank."""
    ranks = ranks_of(path)
    pairs = [(ranks[x[:i]], ranks[x[i:]], r) for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks]
    left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int32)] * 3
    vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [x.hex() for x in ranks]})
    return vocabulary, pa.table({"left_id": left, "right_id": right, "rank": rank})


class Codec:
    """A DuckDB database with the vocabulary, and the ids of the pre-tokens that it has encoded so far."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.bytes_of = {i: x for x, i in self.ranks.items()}
        self.pattern = compiled(public_tokenizers.PATTERN)
        # What DuckDB spills goes to the task's own temporary folder, within a bound.
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.spill.name, "max_temp_directory_size": "1GB"})
        vocabulary, merges = _tables(path)
        self.db.register("arrow_vocabulary", vocabulary)
        self.db.register("arrow_merges", merges)
        self.db.execute("CREATE TABLE vocabulary AS FROM arrow_vocabulary; CREATE TABLE merges AS FROM arrow_merges")
        self.words: dict[str, np.ndarray] = {}

    def merged(self, raw: list[bytes], block: int = 40_000) -> list[list[int]]:
        """The ids of byte strings by the recursion over their whole bytes."""
        out: list[list[int]] = [[]] * len(raw)
        for a in range(0, len(raw), block):
            part = raw[a : a + block]
            size = np.array([len(x) for x in part], dtype=np.int64)
            symbols = pa.table({
                "word": np.repeat(np.arange(a, a + len(part), dtype=np.int32), size),
                "pos": (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32),
                "tok": self.byte[np.frombuffer(b"".join(part), dtype=np.uint8)],
            })
            self.db.register("symbols", symbols)
            for i, ids in self.db.execute(ENCODE).fetchall():
                out[i] = ids
        return out

    def contract(self, raw: list[bytes]) -> list[list[int]]:
        """The ids of byte strings of any length by merging alone."""
        out: list[list[int]] = [[]] * len(raw)
        for some, way in ((lambda n: n <= SEGMENT, self.merged), (lambda n: n > SEGMENT, self.joined)):
            at = [i for i, x in enumerate(raw) if some(len(x))]
            for i, ids in zip(at, way([raw[i] for i in at]) if at else ()):
                out[i] = ids
        return out

    def joined(self, raw: list[bytes]) -> list[list[int]]:
        """The ids of long byte strings: segments, whose seams are mended until every two neighbours there are the encoding of their bytes."""
        cuts = [(i, x[a : a + SEGMENT]) for i, x in enumerate(raw) for a in range(0, len(x), SEGMENT)]
        ids: list[list[int]] = [[] for _ in raw]
        seams: list[list[int]] = [[] for _ in raw]  # places of ids that a seam is before
        for (i, _), part in zip(cuts, self.merged([x for _, x in cuts])):
            seams[i].append(len(ids[i]))
            ids[i] += part
        holds: dict[tuple[int, int], bool] = {}
        reach = WINDOW
        while True:
            asked = {(own[k - 1], own[k]) for own, at in zip(ids, seams) for k in at if 0 < k < len(own)} - holds.keys()
            if asked:
                pairs = sorted(asked)
                found = self.merged([self.bytes_of[a] + self.bytes_of[b] for a, b in pairs])
                holds |= {p: tuple(f) == p for p, f in zip(pairs, found)}
            windows = []
            for i, (own, at) in enumerate(zip(ids, seams)):
                for k in at:
                    if 0 < k < len(own) and not holds[own[k - 1], own[k]]:
                        lo, hi = max(0, k - reach), min(len(own), k + reach)
                        if windows and windows[-1][0] == i and lo <= windows[-1][2]:
                            windows[-1][2] = hi
                        else:
                            windows.append([i, lo, hi])
            if not windows:
                return ids
            again = self.merged([b"".join(self.bytes_of[t] for t in ids[i][lo:hi]) for i, lo, hi in windows])
            seams, old, done = [[] for _ in raw], ids, [0] * len(raw)
            ids = [[] for _ in raw]
            for (i, lo, hi), part in zip(windows, again):
                ids[i] += old[i][done[i] : lo]
                seams[i].append(len(ids[i]))
                ids[i] += part
                seams[i].append(len(ids[i]))
                done[i] = hi
            for i, own in enumerate(old):
                ids[i] += own[done[i] :]
            reach *= 2

    def learn(self, words: list[str]) -> None:
        raw = [x.encode("utf-8") for x in words]
        open_ = [i for i, x in enumerate(raw) if x not in self.ranks]
        self.words.update((words[i], np.array([self.ranks[x]], dtype=np.int32)) for i, x in enumerate(raw) if x in self.ranks)
        self.words.update((words[i], np.array(ids, dtype=np.int32)) for i, ids in zip(open_, self.contract([raw[i] for i in open_])))

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, end to end, and how many each has."""
        if len(self.words) > CACHE:
            self.words.clear()
        found = [self.pattern.findall(x) for x in units]
        self.learn(sorted({w for ws in found for w in ws if w not in self.words}))
        parts = [self.words[w] for ws in found for w in ws]
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(ws) for ws in found], dtype=np.int64)])]
        return np.concatenate([*parts, np.zeros(0, dtype=np.int32)]).astype(np.int32), np.diff(total)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of runs of ids that stand end to end."""
        self.db.register("ids", pa.table({"run": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)}))
        out = [b""] * len(n)
        for run, raw in self.db.execute(DECODE).fetchall():
            out[run] = bytes(raw)
        return out


def encode(df: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of its column text; with_ids adds ids (integers) and decoded (binary)."""
    fields = FIELDS
    if with_ids:
        fields = [*FIELDS, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name for x in fields}]
    at = [df.columns.index(f.name) for f in kept]
    names = [f.name for f in [*kept, *fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(vocabulary)
            units = Units(C.texts_of(b))
            flat, n = codec.encode(units.distinct)
            raw = np.array([*codec.decode(flat, n), None], dtype=object)[:-1]
            cuts = np.cumsum(n) - n
            shown = np.array([*(",".join(map(str, flat[a : a + k].tolist())) for a, k in zip(cuts.tolist(), n.tolist())), None], dtype=object)[:-1]
            joined, decoded = [], []
            for lo, hi in zip(units.offset[:-1], units.offset[1:]):
                run_ = units.index[lo:hi]
                joined.append(",".join(filter(None, shown[run_])))
                decoded.append(b"".join(raw[run_]))
            made = [
                pa.array(units.sums(n)),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            if with_ids:
                made += [pa.array([[int(i) for i in x.split(",")] if x else [] for x in joined], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *made], names=names)

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the bytes of its id arrays, by ordered aggregation in DuckDB. A null array decodes to null, an id outside the vocabulary is an error."""

    def batch(b: pa.RecordBatch) -> list:
        lists = b.column(b.schema.get_field_index(ids))
        codec, known = Codec(vocabulary), lists.is_valid().to_pylist()
        flat = np.array(lists.flatten().cast(pa.int64()), dtype=np.int64)
        missing = sum(i not in codec.bytes_of for i in np.unique(flat).tolist())
        if missing:
            raise ValueError(f"{missing} ids are not in the vocabulary")
        n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], dtype=np.int64)
        return [pa.array([x if k else None for x, k in zip(codec.decode(flat, n), known)], pa.binary())]

    return C.with_columns(df, batch, [T.StructField("decoded", T.BinaryType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return encode(docs, public_tokenizers.path(VOCABULARY)).drop("text")
