"""Token-id files: documents encoded, in ascending doc_id order, into range-coded blocks.

The texts are dealt by ranges of doc_id and sorted within each; a task encodes its texts and writes its blocks to one
file of a Parquet folder (a column of opaque blocks, see range_coder, with each block's directory beside it). A block
holds whole documents, about BLOCK ids; a document of over LONG ids is cut over several blocks. Each block can be
read, checked and decoded by itself. Reading back gives each document's place, length and checksum; the places need
only one sum of ids a file, which is all that the driver gathers.

A distinct unit is encoded once a worker by the tokenizers library while it is held, many in one call; one that is a held unit and a mark takes its
ids from both. Texts with special strings or runs of white space that
the library must see whole are encoded whole. Every document ends with the id `end`. A null or empty text is that id
alone. Rows without an id come first; repeated rows stand side by side, in an order of their texts' hashes. An empty table gives a
folder without blocks, and no rows. Only doc_id and text are read of the input, so other columns can't clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import range_coder
from .pretokens import Units

VOCABULARY = "byte_bpe_50k.json"
END = 2
BLOCK = 1 << 21
LONG = 1 << 21
#: Most entries of the cache of units, and units that the library encodes at once.
UNITS, JOINED = 900_000, 2000
#: The space as byte-level vocabularies write it.
SPACE = "\u0120"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàáâãäåæçèéêëìíîïñòóôõöøùúûüÿßœÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ")
_PLAIN = re.compile(r" \S+(?:\n+\S+)*").fullmatch

#: head: of a document cut over blocks, the first of them; else -1.
BLOCKS = "part int, block long, first long, n long, head long, doc_ids array<long>, lengths array<long>, data binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block long, head long"


class Encoder:
    """The tokenizers library behind a cache of units, of up to UNITS entries and a batch's.

    Units of one space, at their start, that end without white space go to the library JOINED at once, one behind the other: the pattern lets no
    match go over a space before another character, and no id but a unit's first has a space, which tells where each begins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.leading = np.array([(self.library.id_to_token(i) or "").startswith(SPACE) for i in range(self.vocabulary)])
        self.marks = {x: e.ids[0] for x in ".,;:!?" if len((e := self.library.encode(x, add_special_tokens=False)).ids) == 1}
        self.known: dict[str, int] = {}  # numbers of units
        self.ids = np.zeros(1 << 16, dtype=np.int32)  # of the units by their numbers, end to end
        self.ends = np.zeros(1 << 16, dtype=np.int32)  # where each ends in ids; unit 0 is empty
        self.used = np.zeros(1 << 16, dtype=np.int32)  # in how many batches
        self.count = self.kept = 1

    def forget(self) -> None:
        """Keeps those of the known units that came in most batches, half of UNITS at most."""
        used, least = self.used[: self.kept], 2
        while np.count_nonzero(used >= least) > UNITS // 2:
            least += 1
        names = [(x, i) for x, i in self.known.items() if used[i] >= least]
        numbers = np.array([i for _, i in names], dtype=np.int32)
        self.known = {x: k for k, (x, _) in enumerate(names, 1)}
        ids, sizes = self._of(numbers)
        self.used[1 : len(names) + 1], self.used[len(names) + 1 :] = used.take(numbers), 0
        self.count = 1
        self._hold(ids, sizes)
        self.kept = self.count

    def _hold(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers further units, of these ids."""
        filled, count = int(self.ends[self.count - 1]), self.count + len(sizes)
        if count > len(self.ends):
            self.ends, self.used = (np.append(x, np.zeros(count, dtype=np.int32)) for x in (self.ends, self.used))
        if filled + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(filled + len(ids), dtype=np.int32))
        self.ids[filled : filled + len(ids)] = ids
        self.ends[self.count : count] = filled + np.cumsum(sizes)
        self.count = count

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered units, end to end, and how many each has."""
        starts = self.ends.take(numbers - 1)
        after = np.cumsum(self.ends.take(numbers) - starts, dtype=np.int32)
        sizes = np.diff(after, prepend=np.int32(0))
        places = np.repeat(starts - (after - sizes), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.ids.take(places), sizes

    def _kind(self, unit: str) -> int:
        if len(unit) > 64:
            return 3
        if "<|" in unit:
            return 2
        # A letter and a mark are never in one match, whatever stands before.
        if unit[-1:] in self.marks and unit[-2:-1] in _LETTERS and unit[:-1] in self.known:
            return 1
        return 0 if _PLAIN(unit) else 2

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of the units. Those of long ones, which hardly come again, are last and aren't known to later calls."""
        if len(self.known) > UNITS:
            self.forget()
        out = np.fromiter(map(self.known.get, units, repeat(-1)), dtype=np.int32, count=len(units))
        fresh = np.flatnonzero(out < 0)
        names = [units[i] for i in fresh.tolist()]
        # 0: plain, 1: a known unit and a mark, 2: to be encoded alone, 3: long.
        kind = np.fromiter(map(self._kind, names), dtype=np.int8, count=len(names))
        order = np.argsort(kind, kind="stable")
        out[fresh[order]] = self.count + np.arange(len(order), dtype=np.int32)
        names = [names[i] for i in order.tolist()]
        plain, marked, short = (int((kind < k).sum()) for k in (1, 2, 3))
        for a in range(0, plain, JOINED):
            part = names[a : min(a + JOINED, plain)]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.int32)
            begins = np.flatnonzero(self.leading.take(ids))
            if len(begins) != len(part):
                raise ValueError("the vocabulary doesn't keep spaces at the start of units")
            self._hold(ids, np.diff(np.append(begins, len(ids))))
        ids, sizes = self._of(np.array([self.known[x[:-1]] for x in names[plain:marked]], dtype=np.int32))
        self._hold(np.insert(ids, np.cumsum(sizes), [self.marks[x[-1]] for x in names[plain:marked]]), sizes + 1)
        self.kept = self.count - marked + short
        self.known.update(zip(names[:short], range(self.count - marked, self.kept)))
        each = [e.ids for e in self.library.encode_batch_fast(names[marked:], add_special_tokens=False)]
        self._hold(np.fromiter(chain.from_iterable(each), dtype=np.int32), np.fromiter(map(len, each), dtype=np.int32, count=len(each)))
        return out

    def texts(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with its end, end to end, and how many each has."""
        units = Units(texts)
        numbers = self.numbers(units.distinct)
        self.used[numbers] += 1
        self._hold(np.array([end]), np.array([1]))  # the end as a last unit of each text
        index = np.insert(numbers.take(units.index), units.offset[1:], self.count - 1)
        ids, sizes = self._of(index)
        lasts = units.offset[1:] + np.arange(len(texts))
        out = ids, np.diff(np.cumsum(sizes).take(lasts), prepend=0)
        self.used[self.kept : self.count] = 0
        self.count = self.kept
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(df: DataFrame, path: str, vocabulary: str, end: int = END, block: int = BLOCK, long: int = LONG) -> None:
    """Writes the documents of df (doc_id, text) as blocks of ids to a new folder."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def made(doc_ids: list, lengths: list, ids: np.ndarray, head: int = -1) -> pa.RecordBatch:
            nonlocal number, first
            row = [[part], [number], [first], [len(ids)], [head], [doc_ids], [lengths], [range_coder.encode(ids, own.vocabulary)]]
            number, first = number + 1, first + len(ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "block", "first", "n", "head", "doc_ids", "lengths", "data"])

        for b in it:
            doc_ids, texts = b.column(0).to_pylist(), C.texts_of(b)
            for lo, hi in C.chunks([len(x or "") for x in texts], 4 << 20):
                ids, n = own.texts(texts[lo:hi], end)
                at = 0
                for doc, k in zip(doc_ids[lo:hi], n.tolist()):
                    run, at = ids[at : at + k], at + k
                    if (k > long or held + k > 2 * block) and held:
                        yield made(docs, [len(p) for p in parts], np.concatenate(parts))
                        docs, parts, held = [], [], 0
                    if k > long:
                        head = number
                        for a in range(0, k, block):
                            yield made([doc], [len(run[a : a + block])], run[a : a + block], head)
                        continue
                    docs.append(doc)
                    parts.append(run)
                    held += k
                    if held >= block:
                        yield made(docs, [len(p) for p in parts], np.concatenate(parts))
                        docs, parts, held = [], [], 0
        if held:
            yield made(docs, [len(p) for p in parts], np.concatenate(parts))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(batches, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def combined(first: int, second: int, length: int) -> int:
    """The crc32 of two strings together from theirs and the second's length in bytes: the first's crc32 goes through length zero bytes, by squared matrices over GF(2)."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # of one zero bit
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    bits = length * 8
    while bits:
        if bits & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        bits >>= 1
    return first ^ second


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (an array) of each whole document of a folder; a document cut over blocks has a row a block, in (part, block) order."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                ids = range_coder.decode(row["data"]).astype(np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32))
                n = len(row["lengths"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                    names=["doc_id", "part", "block", "ids"],
                )

    return blocks.mapInArrow(batches, "doc_id long, part int, block long, ids array<int>")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n")).collect())  # a row a file
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                raw = range_coder.decode(row["data"]).astype("<u4").tobytes()
                n = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                same = lambda v, kind, m=len(n): pa.array([v] * m, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["part"]] + row["first"] + ends - n), pa.array(n), pa.array(crc, pa.int64()), same(row["part"], pa.int32()), same(row["block"], pa.int64()), same(row["head"], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "block", "head"],
                )

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        crc = 0
        for c, n in zip(pdf["ids_crc32"].tolist(), pdf["n_tokens"].tolist()):
            crc = combined(crc, c, 4 * n)
        head = pdf.head(1)
        return pd.DataFrame({"doc_id": head["doc_id"].astype("Int64"), "start": head["start"], "n_tokens": [pdf["n_tokens"].sum()], "ids_crc32": [crc]})

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # Each block is decoded once, by the branch that it belongs to.
    pieces = blocks.filter("head >= 0").mapInArrow(batches, ROWS).groupBy("part", "head").applyInPandas(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return blocks.filter("head < 0").mapInArrow(batches, ROWS).select(names).unionByName(pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.scratch_dir(spark)}/token-ids-{os.urandom(8).hex()}"
    write_ids(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return documents_of(spark, path)
