"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text's words are the runs of ASCII letters, digits and non-ASCII bytes of its lower-cased form; its shingles are the
runs of WORDS words (a shorter text is one shingle). Two texts are linked when their shingle sets have a Jaccard
similarity of THRESHOLD or more.

1. Each text gets a signature: the minima of TREES x DEPTH random functions of its shingles, 16 bits of each as a label. A
   tree is the trie of the signatures' stretches of DEPTH labels; its nodes at a depth are the groups of equal prefixes, by hash. The recall of matched prefixes is
   measured on planted pairs: in the pass that makes the signatures, every text gets COPIES sets changed at random down to the
   threshold, and each pair says how long a prefix it shares in some tree. Beginning with whole stretches, the matched prefix is
   shortened, label by label, until the share of planted pairs that meet is RECALL or more; the trie nodes at that depth hold
   what is compared.
2. Equal texts go on as one, with their number. In each node every text is tied to the node's least text: a star, so a
   node of any size makes a row a text. The stars' connected components are the candidate groups; every pair that met
   in a node is within one.
3. Within a group every pair whose sizes allow the threshold is compared by whole shingle sets, as the number of links is exact: two
   members of a node may be linked though neither is to the node's least text. A group over BLOCK texts is dealt into blocks by
   hash and each pair of blocks is a task of its own; what leaves a task is a row a text (links, and the least text it
   is tied to), never the pairs. So all links within a group are found, also those that the forest alone would have missed.
4. Classes are the connected components of the links.

The result has a row a document: class_id, the least doc_id of its class; n_links, the number of other documents (copies
included) with a similarity at or over the threshold; n_copies, those with the same text, itself included.

Texts without words (null, empty) link to nothing; each is a class of its own with n_copies 1. Rows of one doc_id with
different texts are different documents; equal rows are copies. Rows without an id take part, and have class_id null
where all of their class have none. A text of any length is read whole. An empty table gives an empty table. Of input columns only
doc_id and text are read; the stage returns all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9998
#: How many planted pairs each text gets.
COPIES = 2
BLOCK = 256
SEED = 20
_NO_ID = -(1 << 63)

_IS_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return shingles_of([(x or "").lower().encode("utf-8", "replace") for x in texts], words)


def shingles_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingle sets of lower-cased texts, end to end, and where each begins."""
    found = C.Words(texts, _IS_WORD)
    at, h = found.grams(words)
    doc = found.doc[at]
    short = np.flatnonzero((found.count > 0) & (found.count < words))
    if len(short):
        whole = np.zeros(len(short), dtype=C.U64)
        for k in range(words - 1):
            has = found.count[short] > k
            whole[has] = whole[has] * C.U64(0x9E3779B97F4A7C15) + found.hash[found.first[short[has]] + k] + C.U64(1)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, C.mix(whole)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, cut: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Of each text with shingles its labels, (texts, trees, depth) numbers of 16 bits."""
    real = np.flatnonzero(np.diff(cut))
    starts = cut[:-1][real]
    rng = np.random.default_rng(SEED)
    scale = rng.integers(1, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    low = (h >> C.U64(32)).astype(np.uint32)
    out = np.zeros((len(real), trees * depth), dtype=np.uint16)
    if len(real):
        changed = np.empty_like(low)
        for i in range(trees * depth):
            np.bitwise_xor(low, shift[i], out=changed)
            changed *= scale[i]
            least = np.minimum.reduceat(changed, starts)
            out[:, i] = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
    return out.reshape(len(real), trees, depth)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest prefix that each pair of signatures shares in some tree."""
    return np.logical_and.accumulate(a == b, axis=2).sum(axis=2).max(axis=1)


def planted(own: np.ndarray, threshold: float, copies: int, seed: int) -> list[np.ndarray]:
    """A shingle set changed at random down to the threshold: as many shingles replaced as it allows, or, in a small set, taken away."""
    rng = np.random.default_rng(seed)
    n = len(own)
    most = int(n * (1 - threshold) / (1 + threshold) + 1e-9)
    gone = most or int(n * (1 - threshold) + 1e-9)
    if not gone:
        return []
    return [np.concatenate([rng.permutation(own)[gone:], rng.integers(0, 1 << 64, most, dtype=C.U64)]) for _ in range(copies)]


def _signatures(docs: DataFrame, words: int, threshold: float, trees: int, depth: int, every: int) -> DataFrame:
    """doc_id, the text's key and its signature (the labels of each tree, end to end, as bytes that sort as they do), null for a text without
    words; met: of one in `every` rows by hash (1: of all), the longest prefix that each planted pair shares."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            asked = b.column(3).to_pylist()
            for lo, texts in C.byte_chunks(b, 1 << 20):
                h, cut = shingles_of([x.decode("utf-8").lower().encode("utf-8") for x in texts], words)
                rows = signatures(h, cut, trees, depth)
                real = np.flatnonzero(np.diff(cut)).tolist()
                signed, met = [None] * len(texts), [None] * len(texts)
                for i, row in zip(real, rows.astype(">u2")):
                    signed[i] = row.tobytes()
                sets = {at: planted(h[cut[i] : cut[i + 1]], threshold, COPIES, int(h[cut[i]] & C.U64(0xFFFFFFFF))) for at, i in enumerate(real) if asked[lo + i]}
                sizes = [len(x) for x in sets.values()]
                own = np.repeat(list(sets), sizes).astype(int)
                flat = [x for some in sets.values() for x in some]
                if flat:  # all of the batch at once
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
                    shared = shared_prefix(signatures(np.concatenate(flat), ends, trees, depth), rows[own])
                    for at, its in zip(sets, np.split(shared, np.cumsum(sizes)[:-1])):
                        met[real[at]] = its.tolist() or None
                n = len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(signed, pa.binary()), pa.array(met, pa.list_(pa.int32()))], names=["doc_id", "tkey", "signature", "met"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("tkey"), "text")
    keyed = keyed.withColumn("asked", F.pmod(F.xxhash64("doc_id", "tkey", F.lit(SEED)), F.lit(every)) == 0)
    return keyed.mapInArrow(batches, "doc_id long, tkey string, signature binary, met array<int>")


def matched_prefix(signed: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> tuple[int, float]:
    """The longest prefix by which the share recall of the planted pairs meet, and that share (1 label if none has it). Without any pairs it is
    the longest that meets the recall by the minima's distribution."""
    met = signed.filter("met IS NOT NULL").select(F.explode("met").alias("k")).groupBy("k").count().collect()  # depth + 1 rows at most
    total = sum(n for _, n in met)
    share = {k: sum(n for j, n in met if j >= k) / total if total else 1 - (1 - threshold**k) ** trees for k in range(1, depth + 1)}
    k = depth
    while k > 1 and share[k] < recall:
        k -= 1
    return k, share[k]


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and root, the least node of its component, of every node of a graph of edges (a, b).

    By contraction: each node points to its least lesser neighbour, the pointers are followed once more, and the edges are
    rewritten to what their ends point to; loops and repeated edges go. Nodes are digests, whose order has nothing to do with the
    edges, so that chains of falling neighbours are short and the nodes with an edge shrink by a steady share a round. (Nodes
    numbered along a path would lose only two a round.) A hub's edges are summed up before the shuffle, or split by the join.
    Every round is stored in the shared folder. At the end the rounds' pointers are followed from the last to the first."""
    spark = edges.sparkSession

    def lesser(rows: DataFrame, a: Column, b: Column) -> DataFrame:
        return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()

    def follow(rows: DataFrame, key: str, points: DataFrame) -> DataFrame:
        """rows (stored) with q, where their key points to, if it does. Many rows may have one key."""
        weights = rows.groupBy(key).agg(F.count(F.lit(1)).alias("w"))
        target, _ = C.store(points.toDF(key, "q").join(weights, key), f"{name}-targets")
        return C.join_on_unique(rows, target, [key], "w", rows.count()).drop("w")

    left, path = C.store(lesser(edges, F.col("a"), F.col("b")), f"{name}-edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        near, _ = C.store(left.groupBy("a").agg(F.min("b").alias("p")), f"{name}-near")
        points, _ = C.store(follow(near, "p", near).select("a", F.coalesce("q", "p").alias("p")), f"{name}-points")
        rounds.append(points)
        once, _ = C.store(follow(left, "a", points).select(F.col("q").alias("pa"), "b"), f"{name}-once")  # every a points
        left, new = C.store(lesser(follow(once, "b", points), F.col("pa"), F.coalesce("q", "b")), f"{name}-edges")
        C.drop_stored(spark, path)
        path = new
    if not rounds:
        return left.toDF("node", "root")
    # From a pointer's target the later rounds' pointers go on. Each step is stored, as it reads the one before it twice.
    roots = rounds[-1]
    for points in reversed(rounds[:-1]):
        on = follow(points, "p", roots).select("a", F.coalesce("q", "p").alias("p"))
        roots, _ = C.store(on.unionByName(roots.join(points.select("a"), "a", "left_anti")), f"{name}-roots")
    tops = roots.select("p").distinct().select(F.col("p").alias("node"), F.col("p").alias("root"))  # they never pointed
    return C.store(roots.toDF("node", "root").unionByName(tops), f"{name}-components")[0]


def _compare(cross: bool, keys: list[str], block: list[int], weight: list[int], texts: list[str], words: int, threshold: float) -> list[tuple]:
    """A row for each text of a task: links by documents and by texts, and the least text that it is tied to."""
    h, cut = shingles(texts, words)
    # Texts by falling size: only those of at least the share threshold of a text's size can be linked to it.
    order = np.argsort(-np.diff(cut), kind="stable")
    keys, block_, weight_ = [keys[i] for i in order], np.array(block)[order], np.array(weight)[order]
    h = np.concatenate([h[cut[i] : cut[i + 1]] for i in order] or [h])
    size = np.diff(cut)[order]
    cut = np.concatenate([[0], np.cumsum(size)])
    last = np.searchsorted(-size, -threshold * size + 1e-9, side="right")
    n = len(keys)
    # Sets as runs of numbers of distinct shingles; a pair's intersection is a sum of flags over a run.
    universe, number = np.unique(h, return_inverse=True)
    flags = np.zeros(len(universe), dtype=np.uint8)
    links, partners, root = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_key = sorted(range(n), key=keys.__getitem__)
    rank = np.empty(n, dtype=np.int64)
    rank[by_key] = np.arange(n)
    for i in range(n - 1):
        end = int(last[i])
        if end <= i + 1:
            continue
        own = number[cut[i] : cut[i + 1]]
        flags[own] = 1
        both = np.add.reduceat(flags[number[cut[i + 1] : cut[end]]], cut[i + 1 : end] - cut[i + 1], dtype=np.int64)
        flags[own] = 0
        near = both >= threshold * (size[i] + size[i + 1 : end] - both) - 1e-9
        if cross:
            near &= block_[i + 1 : end] != block_[i]
        hit = np.flatnonzero(near) + i + 1
        for j in hit.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b, key=rank.__getitem__)] = min(a, b, key=rank.__getitem__)
        links[i] += weight_[hit].sum()
        links[hit] += weight_[i]
        partners[i] += len(hit)
        partners[hit] += 1
    return [(keys[i], int(links[i]), int(partners[i]), keys[top(i)]) for i in range(n)]


def _verify(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """Runs _compare on each task's texts; the rows of a task come together and are held one task at a time. whole: the task is all of its group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None

        def done() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: r[4])
            out = _compare(task[1] != task[2], [r[4] for r in rows], [r[3] for r in rows], [r[5] for r in rows], [r[6] for r in rows], words, threshold)
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array([rows[0][7] == 1] * len(rows))], names=["tkey", "links", "partners", "tied", "whole"])

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != task:
                    if held:
                        yield done()
                    held, task = [], row[:3]
                held.append(row)
        if held:
            yield done()

    order = ["root", "lo", "hi"]
    dealt = members.select(*order, "block", "tkey", "n", "text", "blocks").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "tkey string, links long, partners long, tied string, whole boolean")


def _linked(docs: DataFrame, words: int, threshold: float, trees: int, depth: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of every document; and of every text with words its key, least doc_id (rep), number of documents, links and root,
    which is one for all texts of a class. Both are stored."""
    docs = docs.select("doc_id", "text")
    signed, _ = C.store(_signatures(docs, words, threshold, trees, depth, 1), "signatures")
    prefix, _ = matched_prefix(signed, trees, depth, threshold, recall)
    worded = signed.filter("signature IS NOT NULL")
    texts, _ = C.store(worded.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature")), "texts")
    # A node: a tree and the first labels of its stretch.
    stretch = lambda t: F.substr("signature", t * F.lit(2 * depth) + 1, F.lit(2 * prefix))
    reached = texts.select("tkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, stretch(t)))).alias("node"))
    shared = reached.groupBy("node").agg(F.min("tkey").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared, _ = C.store(shared, "shared-nodes")  # both branches of the join read it
    stars = C.join_on_unique(reached, shared, ["node"], "m", texts.count() * trees, "inner")
    groups = components(stars.filter("tkey <> least").select(F.col("tkey").alias("a"), F.col("least").alias("b")), "candidates")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = C.join_on_unique(groups, sizes, ["root"], "members", texts.count(), "inner")
    members = members.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(texts.select(F.col("tkey").alias("node"), "rep", "n"), "node").withColumnRenamed("node", "tkey")
    # The text itself comes from its least document: one row a text, whatever the number of copies; its equal rows become one.
    known_rep = lambda c: F.coalesce(c, F.lit(_NO_ID))
    source = docs.select(known_rep(F.col("doc_id").cast("long")).alias("rep"), F.md5("text").alias("tkey"), "text")
    members, _ = C.store(members.withColumn("rep", known_rep(F.col("rep"))), "members")
    # By a shuffle at every size: what is broadcast for a small input would have to be shuffled for a large one.
    members = C.join_on_unique(source, members.hint("merge"), ["rep", "tkey"], "n", signed.count(), "inner").dropDuplicates(["tkey"])
    members = members.select("root", "tkey", "n", "blocks", "block", "text")
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    checked, _ = C.store(_verify(tasks, words, threshold), "links")
    linked = checked.groupBy("tkey").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    # A group of one task has its classes; those of more are joined over their tasks.
    parts = components(checked.filter("NOT whole AND tkey <> tied").select(F.col("tkey").alias("a"), F.col("tied").alias("b")), "links")
    tied = checked.filter("whole").select("tkey", F.col("tied").alias("root")).unionByName(parts.toDF("tkey", "root"))
    known = texts.join(linked, "tkey", "left").join(tied, "tkey", "left")
    known = known.select("tkey", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "tkey").alias("root"))
    known, _ = C.store(known, "known")
    return signed, known


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document."""
    signed, known = _linked(docs, words, threshold, trees, depth, recall, block)
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    least = C.join_on_unique(known, least, ["root"], "texts", known.count()).select("tkey", "n", "links", "class_id")
    ids = signed.withColumn("worded", F.col("signature").isNotNull()).select("doc_id", "worded", F.when(F.col("worded"), F.col("tkey")).alias("tkey"))
    alone = ids.filter("NOT worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    found = C.join_on_unique(ids.filter("worded"), least, ["tkey"], "n", signed.count())
    return found.select("doc_id", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("n").alias("n_copies")).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents"))


@C.protected
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that is a doc_id with one text, of each class: that of least doc_id (none comes last), of these that of the
    least text key, and one row of it. A doc_id with texts of several classes stays once for each that it stands for."""
    signed, known = _linked(docs, WORDS, THRESHOLD, TREES, DEPTH, RECALL, BLOCK)
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "tkey"))
    chosen = known.groupBy("root").agg(least.alias("k")).select(F.col("k.rep").alias("_doc"), F.col("k.tkey").alias("_tkey"))
    wordless = signed.filter(F.col("signature").isNull()).select("doc_id", F.coalesce("tkey", F.lit(""))).distinct()
    chosen = chosen.unionByName(wordless.toDF("_doc", "_tkey"))
    columns = docs.columns
    keyed = docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_tkey", F.coalesce(F.md5("text"), F.lit("")))
    named = keyed.join(chosen, ["_doc", "_tkey"], "left_semi").dropDuplicates(["_doc", "_tkey"])
    # Rows without an id may be many of one text: they become one before they are shuffled.
    nameless = keyed.filter("_doc IS NULL").dropDuplicates(["_tkey"]).join(chosen.filter("_doc IS NULL").select("_tkey"), "_tkey", "left_semi")
    return named.select(*(F.col(f"`{c}`") for c in columns)).unionByName(nameless.select(*(F.col(f"`{c}`") for c in columns)))
