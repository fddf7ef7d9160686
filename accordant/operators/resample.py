"""Resampling: null distributions by shuffled labels, and bootstraps by clusters.

Replicates are independent, so they are what is distributed: each task draws a block of replicates, in numpy, over the
aggregated cells and never over a shuffle a replicate. A label shuffle within a stratum leaves the stratum's number of
positives, so the positives of its cells are a multivariate hypergeometric draw from the cells' sizes; a bootstrap of
clusters draws multiplicities of clusters and sums the clusters' cells. What a task holds grows with the number of
cells, not with the observations. Draws are seeded by replicate, so any task can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 50


def replicates(spark, n: int, draw: Callable[[int], dict[str, float]], schema: str, block: int = BLOCK) -> DataFrame:
    """n rows of replicate and what draw(replicate) gives, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"replicate": int(i)} | draw(int(i)) for i in b["id"]])

    return spark.range(0, n, 1, max(1, -(-n // block))).mapInPandas(run, f"replicate long, {schema}")


def _cells(counts: pd.DataFrame, stratum: list[str]) -> list[np.ndarray]:
    """Row numbers of the cells of each stratum."""
    return [np.asarray(v) for v in counts.groupby(stratum, sort=True, dropna=False).indices.values()]


def shuffled_labels(cells: DataFrame, stratum: list[str], statistic: Callable[[np.ndarray, np.ndarray], float], n: int, seed: int) -> DataFrame:
    """The statistic of (positives, support) of all cells, in n replicates that shuffle the labels within each stratum.
    cells: support and gold_positive, in an order of their own; they are collected, as they are aggregates."""
    order = [c for c in cells.columns if c not in ("support", "gold_positive")]
    counts = cells.orderBy(*order).toPandas()
    support, positive, strata = counts["support"].to_numpy(np.int64), counts["gold_positive"].to_numpy(np.int64), _cells(counts, stratum)

    def draw(i: int) -> dict[str, float]:
        rng = np.random.default_rng([seed, i])
        out = np.zeros(len(support), dtype=np.int64)
        for s in strata:
            out[s] = rng.multivariate_hypergeometric(support[s], int(positive[s].sum()), method="marginals")
        return {"value": float(statistic(out, support))}

    return replicates(cells.sparkSession, n, draw, "value double")


def isolated_contrary(isolated_share: float = 0.25, min_support: int = 5) -> Callable[[np.ndarray, np.ndarray], float]:
    """Number of cells of enough support whose minority label has a share over 0 and at most isolated_share."""

    def count(positive: np.ndarray, support: np.ndarray) -> float:
        minority = np.minimum(positive, support - positive)
        return float(((support >= min_support) & (minority > 0) & (minority <= isolated_share * support)).sum())

    return count


def mean_gap(strata: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], float]:
    """Mean over strata of the range of the rates of their cells."""

    def gap(positive: np.ndarray, support: np.ndarray) -> float:
        rate = positive / np.maximum(support, 1)
        ranges = [np.ptp(rate[s][support[s] > 0]) for s in strata if (support[s] > 0).sum() >= 2]
        return float(np.mean(ranges)) if ranges else 0.0

    return gap


def gap_null(cells: DataFrame, stratum: list[str], n: int, seed: int) -> DataFrame:
    """The mean gap with labels shuffled within strata."""
    order = [c for c in cells.columns if c not in ("support", "gold_positive")]
    strata = _cells(cells.orderBy(*order).select(*stratum).toPandas(), stratum)
    return shuffled_labels(cells, stratum, mean_gap(strata), n, seed)


def cluster_bootstrap(counts: DataFrame, stratum: list[str], partition: str, cluster: str, n: int, seed: int, min_rows: int = 5) -> DataFrame:
    """The mean gap in n resamples of clusters within partitions. counts: support and gold_positive by stratum, partition and cluster."""
    rows = counts.orderBy(partition, cluster, *stratum).toPandas()
    cell = rows.groupby([*stratum, partition], sort=True, dropna=False).ngroup().to_numpy()
    owner = rows.groupby([partition, cluster], sort=True, dropna=False).ngroup().to_numpy()
    cells = rows.assign(cell=cell).drop_duplicates("cell").sort_values("cell")
    strata = _cells(cells.reset_index(drop=True), stratum)
    first = rows.assign(owner=owner).drop_duplicates("owner").sort_values("owner")
    clusters = _cells(first.reset_index(drop=True), [partition])
    support, positive = rows["support"].to_numpy(np.float64), rows["gold_positive"].to_numpy(np.float64)
    gap = mean_gap(strata)

    def draw(i: int) -> dict[str, float]:
        rng = np.random.default_rng([seed, i])
        times = np.zeros(len(first))
        for c in clusters:
            times[c] = np.bincount(rng.integers(0, len(c), len(c)), minlength=len(c))
        weight = times[owner]
        s = np.bincount(cell, weights=weight * support, minlength=len(cells))
        p = np.bincount(cell, weights=weight * positive, minlength=len(cells))
        return {"value": gap(p, np.where(s >= min_rows, s, 0))}

    return replicates(counts.sparkSession, n, draw, "value double")


def null_summary(null: DataFrame, observed: float, plus_one: bool = True) -> DataFrame:
    """Mean, sample deviation and 95th percentile of a null, the excess of the observed over its mean, and the share at or over it (with one more above and below, if plus_one)."""
    extra = 1 if plus_one else 0
    return null.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
        (F.lit(observed) - F.avg("value")).alias("excess"),
        ((F.count_if(F.col("value") >= observed) + extra) / (F.count(F.lit(1)) + extra)).alias("p_value"),
    )


def interval(values: DataFrame, share: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """The percentile interval of replicates, of each group and with their number if by names columns."""
    tail = (1 - share) / 2
    at = lambda q: F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY value)")
    out = [F.avg("value").alias("mean"), at(round(tail, 6)).alias("low"), at(round(1 - tail, 6)).alias("high")]
    return values.groupBy(*by).agg(*out, *([F.count("value").alias("replicates")] if by else []))
