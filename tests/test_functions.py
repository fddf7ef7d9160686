import math
from fractions import Fraction
from math import comb

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.functions import keys as K
from accordant.functions import stats as S

count = st.integers(0, 40)


@given(count, count, count, count)
def test_fisher_is_the_exact_sum(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    got = S.fisher(a, b, c, d)
    if not r1 or not r2:
        assert got == 1.0
        return
    p = lambda x: Fraction(comb(r1, x) * comb(r2, c1 - x), comb(r1 + r2, c1))
    own = p(a)
    want = sum(q for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (q := p(x)) <= own + Fraction(1, 10**12))
    assert math.isclose(got, float(min(want, 1)), rel_tol=1e-9, abs_tol=1e-13)
    assert math.isclose(got, S.fisher(c, d, a, b), rel_tol=1e-9)


def test_fisher_rejects_negative_counts():
    with pytest.raises(ValueError):
        S.fisher(-1, 2, 3, 4)


def test_fisher_of_published_tables(spark):
    """Counts, rates difference, p and q of some published comparisons."""
    assert f"{S.fisher(2, 5, 8, 4):.6g}" == "0.169802"
    assert f"{S.fisher(5, 24, 26, 19):.6g}" == "0.000678022"


def test_log_factorial_meets_lgamma():
    import numpy as np

    n = np.array([0, 1, 5, 255, 256, 257, 1000, 10**6])
    assert np.allclose(S.log_factorial(n), [math.lgamma(int(x) + 1) for x in n], rtol=1e-14, atol=1e-12)


def test_wilson_and_entropy(spark):
    low, high = S.wilson(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (3, 10)], "s long, n long").select("s", "n", low.alias("low"), high.alias("high"), S.entropy(S.ratio(F.col("s"), F.col("n"))).alias("h")).collect()
    assert (rows[0].low, rows[0].high, rows[0].h) == (0.0, 0.0, 0.0)
    assert rows[1].low == 0.0 and rows[2].high == 1.0
    assert rows[3].low == pytest.approx(0.10779, abs=1e-4) and rows[3].high == pytest.approx(0.60323, abs=1e-4)
    assert rows[3].h == pytest.approx(0.881291, abs=1e-6)


def test_benjamini_hochberg(spark):
    rows = [("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.03])] + [("g", 0, 0.9)]
    out = S.benjamini_hochberg(spark.createDataFrame(rows, "f string, i int, p double"), "p", "q", ["f"], ["i"]).orderBy("f", "i").collect()
    assert [round(r.q, 6) for r in out] == [0.05, 0.05, 0.05, 0.5, 0.05, 0.9]


def test_six_digits(spark):
    df = spark.createDataFrame([(0.5,), (1 / 3,), (1e-13,), (None,)], "x double").select(S.six_digits("x").alias("x"))
    assert [r.x for r in df.collect()] == ["0.5", "0.333333", "1e-13", None]


def test_keys(spark):
    df = spark.createDataFrame([("a ", "b", "x.d1.s2", "c"), ("", "b", "plain", "c"), (None, "b", None, "c")], "p string, q string, s string, corpus string")
    rows = df.select(K.joined_key(["p", "q"]).alias("j"), K.plain_key(["p", "q"]).alias("k"), K.document_id(F.col("s"), F.col("corpus")).alias("d")).collect()
    assert [r.j for r in rows] == ["a | b", None, None]
    assert [r.k for r in rows] == ["a |b", "|b", "|b"]
    assert [r.d for r in rows] == ["x.d1", "c", "c"]


def test_pairs_and_sets(spark):
    df = spark.createDataFrame([(2, 1, ["b", "", "a", "b", None])], "a int, b int, v array<string>")
    row = df.select(K.pair(F.col("a"), F.col("b")).alias("p"), K.pair(F.col("a"), F.col("a")).alias("s"), K.joined_unique(F.col("v")).alias("v")).first()
    assert (row.p.a, row.p.b, row.s, row.v) == (1, 2, None, "a|b")
