"""Conflict-constrained best-fit packing of documents into sequences of a fixed capacity.

A document's length is its UTF-8 bytes and one end mark (the tokens of a byte-level model). Two documents conflict
when they have the same source or the same duplicate cluster (equal texts but for case and white space); conflicting
documents, and pieces of one document, never share a bin. A document over the capacity is cut into full pieces, each
a bin by itself, and a rest that is packed like any document; no text is dropped or cut short.

The rows (a few numbers each, never the texts) are dealt by a hash of the document id into shards of about SHARD rows,
so that a hot source or cluster is spread evenly, and a shard has the same size whatever the input. In a shard the
pieces go by falling length. Bins stand ordered by residual space; each carries two bitmaps, of its sources and of its
clusters. The search starts at the least residual that holds the piece and goes on through the successors until the
tightest compatible bin is found. Blocks of neighbouring bins carry the intersection of their bitmaps: a block whose
bins all conflict is passed over at once. Without any compatible bin a new one is opened.

A null or empty text has length 1. A null source conflicts with nothing. Repeated rows of one id are documents of one
cluster. An empty table gives an empty table. Of input columns only doc_id, text and source are read, so others can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 8192
SHARD = 4096
BLOCK = 64

SCHEMA = "doc_id long, piece int, n_pieces int, length long, bin_id string, place int, start long, bin_used long"


class Bins:
    """Open bins in order of (residual, number), in blocks that carry the intersection of their bins' bitmaps."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []
        self.common: list[tuple[int, int]] = []
        self.least: list[tuple[int, int]] = []
        self.marks: list[tuple[int, int]] = []  # by bin: bitmaps of sources and of clusters

    def _renew(self, k: int) -> None:
        source = cluster = -1
        for _, b in self.blocks[k]:
            source &= self.marks[b][0]
            cluster &= self.marks[b][1]
        self.common[k], self.least[k] = (source, cluster), self.blocks[k][0]

    def take(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Takes out the tightest compatible bin that holds size."""
        wanted = (size, -1)
        for k in range(max(0, bisect_left(self.least, wanted) - 1), len(self.blocks)):
            if self.common[k][0] & source or self.common[k][1] & cluster:
                continue
            block = self.blocks[k]
            for i in range(bisect_left(block, wanted), len(block)):
                residual, b = block[i]
                if not (self.marks[b][0] & source or self.marks[b][1] & cluster):
                    del block[i]
                    if block:
                        self._renew(k)
                    else:
                        del self.blocks[k], self.common[k], self.least[k]
                    return residual, b
        return None

    def put(self, residual: int, b: int) -> None:
        if not self.blocks:
            self.blocks, self.common, self.least = [[]], [(0, 0)], [(0, 0)]
            k = 0
        else:
            k = max(0, bisect_left(self.least, (residual, b)) - 1)
        insort(self.blocks[k], (residual, b))
        if len(self.blocks[k]) > 2 * BLOCK:
            self.blocks.insert(k + 1, self.blocks[k][BLOCK:])
            del self.blocks[k][BLOCK:]
            self.common.insert(k + 1, (0, 0))
            self.least.insert(k + 1, (0, 0))
            self._renew(k + 1)
        self._renew(k)


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each piece (length, source bit or 0, cluster bit or 0); the pieces come by falling length."""
    bins, where = Bins(), []
    for size, source, cluster in pieces:
        found = bins.take(size, source, cluster)
        if found is None:
            found = (capacity, len(bins.marks))
            bins.marks.append((0, 0))
        residual, b = found
        bins.marks[b] = (bins.marks[b][0] | source, bins.marks[b][1] | cluster)
        where.append(b)
        if residual > size:
            bins.put(residual - size, b)
    return where


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs twice or more: only those can conflict. 0 for the others and for null."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(sorted(v for v, n in counts.items() if n > 1 and v is not None))}
    return [bit.get(v, 0) for v in values]


def _shard(shard: int, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="first", kind="stable")
    source = [None if pd.isna(x) else x for x in rows["source"]]
    cluster = rows["cluster"].tolist()
    docs = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
    full, rest = [], []  # (row, piece, length)
    for i, n in enumerate(rows["length"].tolist()):
        pieces = [(i, p, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))]
        rest += [p for p in pieces if p[2] < capacity]
        full += [p for p in pieces if p[2] == capacity]
    rest.sort(key=lambda p: -p[2])
    source_bit, cluster_bit = _bits(source), _bits(cluster)
    where = pack([(p[2], source_bit[p[0]], cluster_bit[p[0]]) for p in rest], capacity)
    opened = max(where, default=-1) + 1
    placed = [(*p, b) for p, b in zip(rest, where)] + [(*p, opened + k) for k, p in enumerate(full)]
    used: dict[int, int] = {}
    place: dict[int, int] = {}
    pieces_of: dict[int, int] = {}
    out = []
    for i, p, n, b in placed:
        out.append([docs[i], p, i, n, f"{shard}-{b}", place.get(b, 0), used.get(b, 0), b])
        place[b], used[b] = place.get(b, 0) + 1, used.get(b, 0) + n
        pieces_of[i] = pieces_of.get(i, 0) + 1
    made = [(d, p, pieces_of[i], n, name, at, start, used[b]) for d, p, i, n, name, at, start, b in out]
    frame = pd.DataFrame(made, columns=["doc_id", "piece", "n_pieces", "length", "bin_id", "place", "start", "bin_used"])
    return frame.astype({"doc_id": "Int64"})


def best_fit(df: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """A row for each document piece: its bin, its place and start in the bin, and how much of the bin is used.
    Bins never cross shards; bin_id is shard-number."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("length"),
        F.col("source").cast("string").alias("source"),
        F.md5(plain).alias("cluster"),
    )
    shards = max(1, -(-df.count() // shard))
    # The cluster is in the hash for rows without an id and for repeated ones.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("length", pa.int64()), ("bin_id", pa.string()), ("place", pa.int32()), ("start", pa.int64()), ("bin_used", pa.int64())])
        held: pd.DataFrame | None = None
        for b in batches:  # sorted by shard: all shards but the last of what is held are whole
            rows_ = b.to_pandas(integer_object_nulls=True)
            held = rows_ if held is None else pd.concat([held, rows_], ignore_index=True)
            last = held["shard"].iloc[-1] if len(held) else None
            for s, part in held[held["shard"] != last].groupby("shard", sort=False):
                yield pa.RecordBatch.from_pandas(_shard(s, part, capacity), schema=schema, preserve_index=False)
            held = held[held["shard"] == last]
        if held is not None and len(held):
            yield pa.RecordBatch.from_pandas(_shard(int(held["shard"].iloc[0]), held, capacity), schema=schema, preserve_index=False)

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, SCHEMA)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: bin_id and data, the bytes of its pieces in place order, each document ended by byte 0. doc_id is unique in docs."""
    whole = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\0")).alias("raw"))
    cut = packed.join(whole, "doc_id").withColumn("part", F.substring("raw", F.col("piece") * capacity + 1, F.col("length").cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))
    return cut.groupBy("bin_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("data"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(C.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs)
