"""What the training-data operators share: tables, scratch storage, Arrow plumbing and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: list[str] = []
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, one of our own on a local master alone: on a
    cluster other machines couldn't read it, so there it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named}/accordant"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="accordant-"))
    return _own_dir[0]


def store(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and returns it reread, with its path. This cuts the lineage: a lost executor costs a reread."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no later plan reads, through Hadoop's file system so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def protected(stage: Callable) -> Callable:
    """A stage of a pipeline whose input's further columns (beside those of documents) go under names of their own meanwhile, so that none
    clashes with a computed one: they come back with their names and values."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = ("doc_id", "text", "lang", "source", "n_chars")
        inside = [c if c in own else f"further {i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inside), sf_dir).toDF(*docs.columns)

    return run


def with_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[T.StructField]) -> DataFrame:
    """df with columns that fn computes from each Arrow batch. An input column that has the name of a computed one gives way."""
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *fields])
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x in fn(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *made], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def byte_chunks(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as bytes, null as empty, in runs of about limit bytes, each with the place of its first row. Only one run is held."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).fill_null(b"")
    for lo, hi in chunks(pc.binary_length(column).to_pylist(), limit):
        yield lo, column.slice(lo, hi - lo).to_pylist()


def chunks(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of about limit bytes together; a longer one stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# ---- hashing of words in numpy -------------------------------------------------------------

#: Odd multipliers of polynomials over bytes.
_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        filled = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=U64)
        filled[0] = 1
        have = np.cumprod(filled, dtype=U64)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of raw[start:end] for all spans at once, from one prefix sum."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers_of(base, n), out=sums[1:])
    inverse = _powers_of(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts (as bytes): hash, text number, start and end of each, in order."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, separator: bytes = b" "):
        joined = separator.join(texts) + separator
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        flags = np.zeros(len(self.raw) + 1, dtype=np.int8)
        flags[1:] = is_word[self.raw]
        step = np.diff(flags)
        self.start, self.end = np.flatnonzero(step == 1) + 0, np.flatnonzero(step == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(self.raw))
        cuts = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(cuts)
        self.first = cuts[:-1]
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = span_hashes(self.raw, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (a word's number) and hash of each run of n words within a text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        h = np.zeros(m, dtype=U64)
        for k in range(n):
            h = h * U64(_BASE) + self.hash[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(h[at])


def join_on_unique(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """left join (or inner) of a skewed side to one row a key. weight counts left's rows of the key, total all of them: at most
    1000 keys can have over a 1000th of the rows, so those go by a broadcast of that proven size, and only the others' rows are shuffled."""
    cut = max(1000, total // 1000)
    hot = F.broadcast(right.filter(F.col(weight) > cut))
    warm, cold = left.join(hot, key, "inner"), left.join(hot.select(key), key, "left_anti")
    return warm.unionByName(cold.join(right.filter(F.col(weight) <= cut), key, how))
