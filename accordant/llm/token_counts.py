"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a pre-token form a linked list; a heap holds the adjacent pairs that can merge, by rank and place. The
least is popped again and again; a stale one (either side has merged meanwhile) is passed over. The count is the
initial symbols less the merges done; no identifiers are made.

Each distinct pre-token is merged once a worker, within a cache of CACHE entries that empties when it is full; the
texts are only looked up. A null or empty text has 0 tokens. Repeated rows each get their count; columns of the
computed names are replaced, others pass through. A text or word of any length is merged whole. An empty table gives an empty table. Nothing
is shuffled.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C
from .pretokens import Units, compiled

LIMIT = 1024
CACHE = 400_000
VOCABULARY = "byte_bpe_50k.json"

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def byte_symbols() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        self.special = [x["content"] for x in data["added_tokens"]]
        self.byte = [vocabulary[x] for x in byte_symbols()]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.pattern = compiled(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}

    def merge_count(self, raw: bytes) -> int:
        """Symbols left when no pair of raw's symbols can merge."""
        n = len(raw)
        symbols = [self.byte[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, merged = self.ranks, self.merged
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 20 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text; a special string is one token and parts what stands around it."""
        for x in self.special:
            if x in text:
                parts = text.split(x)
                return len(parts) - 1 + sum(self.count(p) for p in parts)
        total, cache = 0, self.cache
        for word in self.pattern.findall(text):
            n = cache.get(word)
            if n is None:
                n = self.merge_count(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """df with the columns of FIELDS for its column text. vocabulary: path of a byte-level BPE as JSON, there on every executor."""

    def batch(b: pa.RecordBatch) -> list:
        own, texts = merger(vocabulary), C.texts_of(b)
        units = Units(texts)
        counts = units.sums(np.array([own.count(x) for x in units.distinct], dtype=np.int64))
        return [np.array([len(x or b"") for x in C.bytes_of(b)], dtype=np.int64), counts, counts > limit]

    return C.with_columns(df, batch, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY)).drop("text")
