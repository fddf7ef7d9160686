"""Statistics as Column expressions, and the two that Spark's functions lack as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Quantiles of chi squared at 0.95 by degrees of freedom.
CHI_SQUARED_95 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.07, 6: 12.592}
Z = 1.96
#: Tables at most this much likelier than the one seen count as no likelier.
FISHER_SLACK = 1e-12


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(s: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of s successes in n, within 0 to 1; (0, 0) for n = 0."""
    n = n.cast("double")
    p = s.cast("double") / F.nullif(n, F.lit(0.0))
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / scale
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def entropy(p: Column) -> Column:
    """Shannon entropy in bits of a share; 0 at its ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!, from a table up to 256 and by Stirling's series beyond."""
    n = np.asarray(n, dtype=np.float64)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 257)))])
    x = np.maximum(n, 1.0)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n <= 256, table[np.minimum(n, 256).astype(np.int64)], series)


def fisher_batch(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Two-sided exact p of tables: the sums over tables with their margins that are no likelier. 1 for an empty row.

    Likelihoods rise to the mode and fall from it, so what is no likelier than a table is all beyond two places, found by bisection. From
    either the terms are added up outward, each from the one before by their ratio, as far as they count: what lies further than 30 and
    8.7 standard deviations from a place beyond the mode is below 1e-16 of what lies nearer. So the work grows with the square root of the margins. About step terms are held at a time."""
    a, b, c, d = (np.asarray(x, dtype=np.int64) for x in (a, b, c, d))
    if len(a) and min(x.min() for x in (a, b, c, d)) < 0:
        raise ValueError("negative counts")
    r1, r2, c1 = a + b, c + d, a + c
    total = r1 + r2
    fixed = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(total - c1) - log_factorial(total)

    def likely(x: np.ndarray) -> np.ndarray:
        return np.exp(fixed - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x))

    bound = likely(a) + FISHER_SLACK
    low, high = np.maximum(0, c1 - r2), np.minimum(r1, c1)
    mode = np.clip((r1 + 1) * (c1 + 1) // (total + 2), low, high)

    def first(outward: int, near: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place nearest to the mode, from near on, that is no likelier than the bound; beyond end where none is."""
        lo, hi = np.zeros(len(a), dtype=np.int64), np.maximum(outward * (end - near) + 1, 0)
        while (lo < hi).any():
            middle = (lo + hi) // 2
            x = near + outward * np.minimum(middle, np.maximum(outward * (end - near), 0))
            fits = likely(np.clip(x, low, high)) <= bound
            lo, hi = np.where(fits | (lo >= hi), lo, middle + 1), np.where(fits & (lo < hi), middle, hi)
        return near + outward * lo

    right, left = first(1, mode, high), first(-1, mode - 1, low)
    big = np.maximum(total.astype(np.float64), 2)
    deviation = np.sqrt(r1 / big * r2 / big * c1 * (total - c1) / (big - 1))
    reach = (30 + 8.7 * deviation).astype(np.int64) + 1
    out = np.zeros(len(a))
    order = np.argsort(reach, kind="stable")
    at = 0
    while at < len(a):
        end = at + max(1, int(np.searchsorted(np.cumsum(reach[order[at:]]), step, side="right")))
        i = order[at:end]
        width = min(int(reach[i].max()), int((high - low)[i].max()) + 1)
        k = np.arange(width - 1)
        # A tail to the left is one to the right with the columns swapped.
        for start, columns, outside in ((right[i], c1[i], right[i] > high[i]), ((r1 - left)[i], (total - c1)[i], left[i] < low[i])):
            x = start[:, None] + k
            ratio = np.maximum((r1[i][:, None] - x) * (columns[:, None] - x), 0) / np.maximum((x + 1) * (r2[i][:, None] - columns[:, None] + x + 1), 1)
            head = np.where(outside, 0.0, np.exp(fixed[i] - log_factorial(start) - log_factorial(np.maximum(r1[i] - start, 0)) - log_factorial(np.maximum(columns - start, 0)) - log_factorial(np.maximum(r2[i] - columns + start, 0))))
            out[i] += head * (1 + np.cumprod(ratio, axis=1).sum(axis=1))
        at = end
    return np.where((r1 == 0) | (r2 == 0), 1.0, np.clip(out, 0.0, 1.0))


def fisher(a: int, b: int, c: int, d: int, step: int = 1 << 20) -> float:
    return float(fisher_batch(*(np.array([x]) for x in (a, b, c, d)), step)[0])


def adjusted(p: np.ndarray) -> np.ndarray:
    """Benjamini and Hochberg's q of p, in their places."""
    order = np.argsort(p, kind="stable")
    scaled = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1.0, np.minimum.accumulate(scaled[::-1])[::-1])
    return out


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_batch(*(x.to_numpy(np.int64) for x in (a, b, c, d))), dtype="float64")


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    """A number as text with six significant digits, without trailing zeros."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.6g}")


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    from math import erf, sqrt

    return x.map(lambda v: 0.5 * (1 + erf(v / sqrt(2))))


def benjamini_hochberg(df: DataFrame, p: str, q: str, families: list[str], ties: list[str]) -> DataFrame:
    """df with q: within each family, p * m / rank, running least from the largest p on, 1 at most. ties order equal p.
    A family is one partition of the window: families hold tests (cells), not observations."""
    own = Window.partitionBy(*families)
    rank = F.row_number().over(own.orderBy(p, *ties))
    m = F.count(F.lit(1)).over(own)
    scaled = df.withColumn("_rank", rank).withColumn("_scaled", F.col(p) * m / F.col("_rank"))
    least = F.min("_scaled").over(own.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn(q, F.least(F.lit(1.0), least)).drop("_rank", "_scaled")


def z_two_proportions(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Pooled z of two shares; null where it isn't defined."""
    pooled = (s1 + s2) / F.nullif((n1 + n2).cast("double"), F.lit(0.0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n1.cast("double"), F.lit(0.0)) + 1 / F.nullif(n2.cast("double"), F.lit(0.0))))
    return (ratio(s1, n1) - ratio(s2, n2)) / F.nullif(error, F.lit(0.0))
