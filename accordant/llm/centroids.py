"""Centroid clustering of integer vectors, assigned by partial-distance search.

Kept are vectors of exactly DIMENSION components, none null, NaN or infinite, each turned into floor(SCALE * x). The first CLUSTERS
of them by the sha256 of `2:<vec_id>` are the centroids; each of ROUNDS rounds assigns every vector to its nearest centroid
(squared Euclidean distance; of equal distances the smaller number) and replaces every centroid that has vectors by their
componentwise floored mean; then all are assigned once more.

An assignment adds up integer squared differences over blocks of dimensions, those of highest variance over all kept vectors first.
After the first block the centroid of the least sum is finished, which gives a vector its current best; a centroid whose sum is
strictly above it is abandoned, after every block, and what is left has all dimensions added. So results don't depend on the order.

Each task of a round returns a row a centroid (count and sums), summed by centroid before and after one small shuffle; the
driver sees CLUSTERS rows. Vectors never move; the integers are stored once and read by every round.

A null embedding, one of another length or with a null or non-finite component isn't kept and has no row; nor is one with a component
of 2^19 or more in size, whose squares don't fit into 64 bits. A row without an id is assigned like others but never begins a
centroid. Repeated rows each get a row and may each begin a centroid, in the order of their components where ids are equal. With
fewer than CLUSTERS vectors there are as many centroids. An empty table gives an empty table. Further columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DIMENSION, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
SEED = "2"
#: Sizes of the blocks of dimensions; after each of them centroids are abandoned.
BLOCKS = (16, 16, 32)
LARGEST = 1 << 19
#: Vectors compared at a time.
ROWS = 2048


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v, the floored components of the vectors that are kept."""
    x = F.col(vector).cast("array<double>")
    good = (F.size(x) == DIMENSION) & F.forall(x, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return df.filter(good).select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; order: the dimensions, as they are added up."""
    x, centroids = x[:, order], centroids[:, order]
    first = BLOCKS[0]
    part = np.empty((len(x), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids[:, :first]):
        diff = x[:, :first] - c
        part[:, k] = np.einsum("ij,ij->i", diff, diff)
    guess = part.argmin(axis=1)
    diff = x[:, first:] - centroids[guess, first:]
    best = part[np.arange(len(x)), guess] + np.einsum("ij,ij->i", diff, diff)
    row, number = np.nonzero(part <= best[:, None])
    total, lo = part[row, number], first
    for size in BLOCKS[1:]:
        diff = x[row, lo : lo + size] - centroids[number, lo : lo + size]
        total, lo = total + np.einsum("ij,ij->i", diff, diff), lo + size
        if lo == DIMENSION:
            np.minimum.at(best, row, total)
        alive = total <= best[row]
        row, number, total = row[alive], number[alive], total[alive]
    # The pairs are in order of vector and centroid, and only those of a vector's least distance are left.
    one = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    return number[one], total[one]


def _vectors(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), DIMENSION)


def _dimensions(vectors: DataFrame) -> np.ndarray:
    """The dimensions by falling variance over all vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(DIMENSION), np.zeros(DIMENSION)
        for b in batches:
            x = _vectors(b).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(DIMENSION), "n": np.full(DIMENSION, float(n)), "s": s, "q": q})

    rows = vectors.select("v").mapInArrow(sums, "d long, n double, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = {r.d: r.q / r.n - (r.s / r.n) ** 2 for r in rows.collect()}
    return np.array(sorted(range(DIMENSION), key=lambda d: (-variance.get(d, 0), d)))


def _sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each centroid's vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), DIMENSION), dtype=np.int64)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                x = _vectors(b.slice(lo, ROWS))
                number, _ = nearest(x, centroids, order)
                count += np.bincount(number, minlength=len(centroids))
                np.add.at(total, number, x)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    made = vectors.select("v").mapInArrow(sums, "cluster int, n long, s array<long>")
    rows = made.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(DIMENSION))).alias("s")).collect()
    return {r.cluster: (r.n, r.s) for r in rows}


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after the rounds, and the order of the dimensions."""
    first = vectors.filter("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "v").limit(clusters)
    centroids = np.array([r.v for r in first.select("v").collect()], dtype=np.int64).reshape(-1, DIMENSION)
    order = _dimensions(vectors)
    for _ in range(rounds if len(centroids) else 0):
        for k, (n, s) in _sums(vectors, centroids, order).items():
            centroids[k] = [x // n for x in s]
    return centroids, order


def assign(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each vector."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, len(b), ROWS):
                part = b.slice(lo, ROWS)
                number, distance = nearest(_vectors(part), centroids, order)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    return (vectors if len(centroids) else vectors.filter("false")).select("vec_id", "v").mapInArrow(batches, schema)


def cluster(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances over the cluster and over all, and the sha256 of the cluster's centroid."""
    spark = df.sparkSession
    vectors, _ = C.store(integers(df), "vectors")
    centroids, order = fit(vectors)
    found, _ = C.store(assign(vectors, centroids, order), "assigned")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, sums[k], sum(sums.values()), digests[k]) for k in sorted(sums)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle_sql() -> str:
    """Every distance of every round in full."""
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LARGEST})) = {DIMENSION})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM e WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT k, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d FROM
            (SELECT k, c, list_sum(list_transform(range(1, {DIMENSION + 1}), lambda i: (e.v[i] - c{r}.v[i]) * (e.v[i] - c{r}.v[i])))::BIGINT AS d FROM e, c{r}) GROUP BY k)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM
                (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS i FROM a{r} a JOIN e USING (k)) GROUP BY c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN e USING (k) JOIN c{ROUNDS} z USING (c)"""
