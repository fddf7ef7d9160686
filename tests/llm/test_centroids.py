import hashlib

import numpy as np
from pyspark.sql import functions as F

from accordant.llm import centroids as K

from ..oracle import assert_same


def test_sql(spark, sf):
    assert_same(K.query(spark, sf), K.oracle_sql(), sf)


def brute(rows):
    """Rows of (vec_id, integers) by plain loops over every distance."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for i, v in rows if i is not None][: K.CLUSTERS]
    at = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(K.ROUNDS):
        found = [at(v)[1] for _, v in rows]
        for k in range(len(centroids)):
            own = [v for (_, v), f in zip(rows, found) if f == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [at(v) for _, v in rows]
    sums = [sum(d for d, f in last if f == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), k, d, sums[k], sum(sums), digest[k]) for (i, _), (d, k) in zip(rows, last))


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    grid = (rng.integers(-3, 4, (12, 64)) / 64).tolist()  # few values: ties and equal vectors
    rows = [(i, grid[i % 12][:63] + [float(i % 5)]) for i in range(120)]
    rows += [(7, grid[3]), (7, grid[3]), (None, grid[4]), (None, [-0.001] * 64), (5, [0.1] * 64)]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [1e30] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("V", F.lit(1))
    got = K.cluster(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).collect()
    want = brute([(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows])
    assert sorted((repr(r.vec_id), *r[1:]) for r in got) == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = K.cluster(df).collect()
    assert {r.cluster for r in got} == {0, 1} and {r.distance for r in got} == {0}
    assert K.cluster(df.filter("vec_id > 2")).count() == 0
    assert K.cluster(df.withColumn("vec_id", F.lit(None).cast("long"))).count() == 0


def test_abandoning_changes_nothing():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-6, 7, (500, 64)), rng.integers(-6, 7, (40, 64))
    c[7] = c[3]
    x[:40] = c
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        number, distance = K.nearest(x, c, order)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert len(K.nearest(x[:0], c, np.arange(64))[0]) == 0
