"""Null models and bootstraps over strata of cells: signed contrasts of two partitions, resampled clusters, a ladder of matchings.

What comes to the driver is bounded by the strata, never by documents: clusters get their weights where they are read, from a generator
seeded by (seed, cluster), and what leaves a task is a sum a replicate and cell. A cluster's weight is a Poisson draw of mean 1, the
limit of drawing as many clusters as there are, with replacement, from each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .resample import replicates


def eligible(cells: DataFrame, stratum: list[str], min_rows: int = 5, partitions: int = 2) -> DataFrame:
    """Cells of enough support, of strata that have such cells in enough partitions."""
    enough = cells.filter(F.col("support") >= min_rows)
    return enough.join(enough.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= partitions).drop("_n"), stratum, "left_semi")


def additive_logit(stratum: np.ndarray, part: np.ndarray, positive: np.ndarray, support: np.ndarray, c: float, steps: int = 100) -> np.ndarray:
    """The logit of each cell under a ridge model in which stratum and partition add up. Numbers are 0, 1, and so on.

    Newton's steps; strata touch only themselves and the few partitions, so they are eliminated and what is solved is as large as the partitions."""
    y, n = np.asarray(positive, dtype=np.float64), np.asarray(support, dtype=np.float64)
    k, q = int(stratum.max()) + 1, int(part.max()) + 1
    side = np.concatenate([np.eye(q)[part], np.ones((len(part), 1))], axis=1)  # partitions and the intercept, which isn't penalised
    ridge = np.append(np.ones(q), 0.0)
    u, v = np.zeros(k), np.zeros(q + 1)

    def loss(u: np.ndarray, v: np.ndarray) -> float:
        z = u[stratum] + side @ v
        return 0.5 * float(u @ u + ridge @ v**2) + c * float(n @ np.logaddexp(0, z) - y @ z)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u[stratum] + side @ v, -700, 700)))
        g, h = c * (n * p - y), c * n * p * (1 - p)
        gu, gv = u + np.bincount(stratum, g, k), ridge * v + side.T @ g
        du = 1 + np.bincount(stratum, h, k)
        mixed = np.stack([np.bincount(stratum, h * side[:, j], k) for j in range(q + 1)], axis=1)
        schur = np.diag(ridge) + (side.T * h) @ side - mixed.T @ (mixed / du[:, None])
        move_v = np.linalg.lstsq(schur, gv - mixed.T @ (gu / du), rcond=None)[0]
        move_u = (gu - mixed @ move_v) / du
        scale, now = 1.0, loss(u, v)
        while scale > 1e-8 and loss(u - scale * move_u, v - scale * move_v) > now:
            scale /= 2
        u, v = u - scale * move_u, v - scale * move_v
        if scale * np.abs(move_u[stratum] + side @ move_v).max() < 1e-10:
            break
    return u[stratum] + side @ v


def contrast(first: np.ndarray, second: np.ndarray) -> dict[str, float]:
    """Mean, sample deviation, mean size and number of the strata's signed differences of rates (second less first)."""
    d = second - first
    n = len(d)
    return {"mean": float(d.mean()) if n else float("nan"), "sd": float(d.std(ddof=1)) if n > 1 else 0.0 if n else float("nan"), "mean_abs": float(np.abs(d).mean()) if n else float("nan"), "strata": float(n)}


_CONTRAST = "mean double, sd double, mean_abs double, strata double"


def pair_table(cells: DataFrame, stratum: list[str], partition: str, pair: tuple[str, str], min_rows: int = 5) -> pd.DataFrame:
    """A row a stratum that both partitions have enough rows of: supports s1, s2 and positives y1, y2. As large as the strata."""
    side = lambda p, i: cells.filter((F.col(partition) == p) & (F.col("support") >= min_rows)).select(*stratum, F.col("support").alias(f"s{i}"), F.col("gold_positive").alias(f"y{i}"))
    return side(pair[0], 1).join(side(pair[1], 2), stratum).orderBy(*stratum).toPandas()


def pair_contrast(cells: DataFrame, stratum: list[str], partition: str, pair: tuple[str, str], min_rows: int = 5) -> dict[str, float]:
    t = pair_table(cells, stratum, partition, pair, min_rows)
    return contrast((t["y1"] / t["s1"]).to_numpy(), (t["y2"] / t["s2"]).to_numpy())


def pair_shuffles(cells: DataFrame, stratum: list[str], partition: str, pair: tuple[str, str], n: int, seed: int, min_rows: int = 5) -> DataFrame:
    """The contrast with labels shuffled within each stratum, n times: the first partition's positives are a hypergeometric draw."""
    t = pair_table(cells, stratum, partition, pair, min_rows)
    s1, s2, y = (t[c].to_numpy(np.int64) for c in ("s1", "s2", "y1"))
    y = y + t["y2"].to_numpy(np.int64)

    def draw(i: int) -> dict[str, float]:
        got = np.random.default_rng([seed, i]).hypergeometric(y, s1 + s2 - y, s1) if len(t) else y
        return contrast(got / s1, (y - got) / s2)

    return replicates(cells.sparkSession, n, draw, _CONTRAST)


def pair_additive(cells: DataFrame, stratum: list[str], partition: str, pair: tuple[str, str], n: int, seed: int, min_rows: int = 5, c: float = 10.0) -> DataFrame:
    """The contrast of draws from a logit in which stratum and partition add up, fitted once."""
    t = pair_table(cells, stratum, partition, pair, min_rows)
    s = t[["s1", "s2"]].to_numpy(np.int64).ravel()
    y = t[["y1", "y2"]].to_numpy(np.int64).ravel()
    z = additive_logit(np.repeat(np.arange(len(t)), 2), np.tile([0, 1], len(t)), y, s, c) if len(t) else np.zeros(0)

    def draw(i: int) -> dict[str, float]:
        got = np.random.default_rng([seed, i]).binomial(s, 1 / (1 + np.exp(-z))) / np.maximum(s, 1)
        return contrast(got[::2], got[1::2])

    return replicates(cells.sparkSession, n, draw, _CONTRAST)


def _generator(seed: int, key: int, stream: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed << 8 | stream, key & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))


def numbered(counts: DataFrame, by: list[str]) -> tuple[DataFrame, pd.DataFrame]:
    """counts with cell, the number of its columns by, and the numbered cells (as many as strata and partitions)."""
    names = counts.select(*by).distinct().orderBy(*by).toPandas()
    names["cell"] = np.arange(len(names), dtype=np.int32)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*by).schema.fields)
    return counts.join(F.broadcast(counts.sparkSession.createDataFrame(names, f"{kinds}, cell int")), by), names


def resampled(counts: DataFrame, cluster: Column, cells: int, n: int, seed: int, logits: np.ndarray | None = None, sigma: float = 0.0) -> DataFrame:
    """replicate, cell, support and positive of n resamples of clusters. counts: cell, support and gold_positive by cluster. With logits
    (replicates x cells) the positives are drawn from them instead, moved by a normal of deviation sigma a replicate and cluster."""
    shared = counts.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, y = np.zeros((n, cells)), np.zeros((n, cells))
        for b in batches:
            for key, rows in b.groupby("key", sort=False):
                w = _generator(seed, int(key), 0).poisson(1.0, n)
                moved = _generator(seed, int(key), 1).normal(0.0, sigma, n) if sigma else 0.0
                for cell, size, hits in zip(rows["cell"], rows["support"], rows["gold_positive"]):
                    s[:, cell] += w * size
                    if shared.value is None:
                        y[:, cell] += w * hits
                    else:
                        z = np.clip(shared.value[:, cell] + moved, -500, 500)
                        y[:, cell] += _generator(seed, int(key), 2 + int(cell)).binomial(w * int(size), 1 / (1 + np.exp(-z)))
        r, c = np.nonzero(s)
        for a in range(0, len(r), 100_000):
            i, k = r[a : a + 100_000], c[a : a + 100_000]
            yield pd.DataFrame({"replicate": i, "cell": k.astype(np.int32), "support": s[i, k], "positive": y[i, k]})

    dealt = counts.select(F.xxhash64(cluster).alias("key"), "cell", "support", "gold_positive").repartition(counts.sparkSession.sparkContext.defaultParallelism, "key")
    sums = dealt.mapInPandas(run, "replicate long, cell int, support double, positive double")
    return sums.groupBy("replicate", "cell").agg(F.sum("support").alias("support"), F.sum("positive").alias("positive"))


def gap_resamples(counts: DataFrame, stratum: list[str], partition: str, cluster: str, n: int, seed: int, min_rows: int = 5) -> DataFrame:
    """replicate and value, the mean range of rates over the strata that a resample has enough rows of in two partitions."""
    rows, names = numbered(counts, [*stratum, partition])
    sums = resampled(rows, F.struct(partition, cluster), len(names), n, seed).filter(F.col("support") >= min_rows)
    where = F.broadcast(counts.sparkSession.createDataFrame(names.assign(stratum=names.groupby(stratum, dropna=False).ngroup())[["cell", "stratum"]], "cell int, stratum long"))
    rate = F.col("positive") / F.col("support")
    gaps = sums.join(where, "cell").groupBy("replicate", "stratum").agg((F.max(rate) - F.min(rate)).alias("gap"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
    return gaps.groupBy("replicate").agg(F.avg("gap").alias("value"))


def clustered_contrast(counts: DataFrame, stratum: list[str], partition: str, pair: tuple[str, str], cluster: str, n: int, seed: int, sigma: float, min_rows: int = 5, c: float = 1e6) -> DataFrame:
    """The contrast under an additive logit that is fitted anew to every resample of clusters, with a random intercept a cluster: replicate and
    the contrast's values. Resamples with fewer than two strata, or of one label alone, give no row."""
    rows, names = numbered(counts.filter(F.col(partition).isin(*pair)), [*stratum, partition])
    if not len(names):
        return counts.sparkSession.createDataFrame([], f"replicate long, {_CONTRAST}")
    spark = counts.sparkSession
    of, side = names.groupby(stratum, dropna=False).ngroup().to_numpy(), (names[partition] == pair[1]).to_numpy().astype(int)
    where = F.broadcast(spark.createDataFrame(names.assign(stratum=of, side=side)[["cell", "stratum", "side"]], "cell int, stratum long, side int"))
    both = ["replicate", "stratum"]

    def usable(sums: DataFrame) -> DataFrame:
        """A row a replicate and stratum that both partitions have enough rows of."""
        first, second = (F.max(F.when(F.col("side") == i, F.struct("cell", "support", "positive"))) for i in (0, 1))
        return sums.filter(F.col("support") >= min_rows).join(where, "cell").groupBy(*both).agg(first.alias("a"), second.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(both)
        cut = np.flatnonzero(np.diff(pdf["replicate"].to_numpy(), prepend=-1, append=-1))
        columns = {x: pdf[x].to_numpy() for x in pdf.columns}
        for lo, hi in zip(cut[:-1], cut[1:]):
            y, s = (np.stack([columns[f"{x}_{i}"][lo:hi] for i in "ab"], axis=1).ravel() for x in ("positive", "support"))
            if hi - lo > 1 and 0 < y.sum() < s.sum():
                z = additive_logit(np.repeat(np.arange(hi - lo), 2), np.tile([0, 1], hi - lo), y, s, c)
                cells = np.stack([columns["cell_a"][lo:hi], columns["cell_b"][lo:hi]], axis=1).ravel()
                out.append(pd.DataFrame({"replicate": columns["replicate"][lo], "cell": cells, "logit": np.clip(z, -20.7, 20.7)}))
        return pd.concat(out) if out else pd.DataFrame({"replicate": np.zeros(0, np.int64), "cell": np.zeros(0, np.int32), "logit": np.zeros(0)})

    flat = usable(resampled(rows, F.struct(partition, cluster), len(names), n, seed)).select(*both, *(F.col(f"{i}.{x}").alias(f"{x}_{i}") for i in "ab" for x in ("cell", "support", "positive")))
    fitted = flat.groupBy(F.floor(F.col("replicate") / 50)).applyInPandas(fit, "replicate long, cell int, logit double").toPandas()
    logits = np.full((n, len(names)), np.nan)
    logits[fitted["replicate"], fitted["cell"]] = fitted["logit"]
    used = F.broadcast(spark.createDataFrame([(int(i),) for i in sorted(set(fitted["replicate"]))], "replicate long"))
    drawn = usable(resampled(rows, F.struct(partition, cluster), len(names), n, seed, np.nan_to_num(logits), sigma)).join(used, "replicate")
    d = F.col("b.positive") / F.col("b.support") - F.col("a.positive") / F.col("a.support")
    return drawn.groupBy("replicate").agg(F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.avg(F.abs(d)).alias("mean_abs"), F.count(F.lit(1)).cast("double").alias("strata"))


def significant_resamples(counts: DataFrame, key: str, partition: str, cluster: str, n: int, seed: int, min_support: int = 5, alpha: float = 0.05) -> DataFrame:
    """replicate, significant and tests: pairwise exact tests of each key's partitions with a false-discovery rate under alpha, in n resamples
    of clusters."""
    rows, names = numbered(counts, [key, partition])
    of, part = names[key].to_numpy(), names[partition].to_numpy()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf[pdf["support"] >= min_support]
        t = t.assign(key=of[t["cell"]], part=part[t["cell"]])
        both = t.merge(t, on="key")
        both = both[both["part_x"] < both["part_y"]]
        y1, y2 = both["positive_x"].to_numpy(np.int64), both["positive_y"].to_numpy(np.int64)
        p = S.fisher_batch(y1, both["support_x"].to_numpy(np.int64) - y1, y2, both["support_y"].to_numpy(np.int64) - y2)
        return pd.DataFrame({"replicate": [int(pdf["replicate"].iloc[0])], "significant": [int((S.adjusted(p) < alpha).sum())], "tests": [len(p)]})

    return resampled(rows, F.struct(partition, cluster), len(names), n, seed).groupBy("replicate").applyInPandas(count, "replicate long, significant long, tests long")


def ladder(levels: dict[str, DataFrame], base: list[str], partition: str, min_rows: int = 5) -> DataFrame:
    """base and the gap at each level, averaged over the level's strata within a base key, of those base keys that every level has. levels: the cells by
    base, the level's own columns and the partition."""
    out = None
    for name, cells in levels.items():
        stratum = [x for x in cells.columns if x not in (partition, "support", "gold_positive", "gold_negative")]
        rate = F.col("gold_positive") / F.col("support")
        gaps = cells.filter(F.col("support") >= min_rows).groupBy(*stratum).agg((F.max(rate) - F.min(rate)).alias("gap"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
        part = gaps.groupBy(*base).agg(F.avg("gap").alias(name))
        out = part if out is None else out.join(part, base)
    return out


def ladder_intervals(paired: DataFrame, levels: list[str], n: int, seed: int) -> DataFrame:
    """level, mean and its percentile interval over resamples of base keys; and of the gain of each later level over the first (`level - first`)."""
    rows = paired.orderBy(*[x for x in paired.columns if x not in levels]).select(*levels).toPandas().to_numpy(np.float64)  # a row a base key
    rng = np.random.default_rng(seed)
    values = {level: rows[:, i] for i, level in enumerate(levels)} | {f"{level} - {levels[0]}": rows[:, i] - rows[:, 0] for i, level in enumerate(levels) if i}
    out = []
    for name, v in values.items():
        drawn = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(n)]) if len(v) else np.array([np.nan])
        low, high = np.percentile(drawn, [2.5, 97.5])
        out.append((name, float(v.mean()) if len(v) else None, float(low), float(high), len(v)))
    return paired.sparkSession.createDataFrame(out, "level string, mean double, low double, high double, base_keys long")


def pearson_residuals(rows: DataFrame, stratum: list[str], partition: str, label: str, c: float = 1e6) -> DataFrame:
    """rows with residual: of the 0/1 label under a logit in which stratum and partition add up, in units of its deviation. The fit
    is from counts; what is joined back is a row a cell."""
    by = [*stratum, partition]
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("support"), F.sum(label).alias("positive")).orderBy(*by).toPandas()
    if not len(cells):
        return rows.withColumn("residual", F.lit(None).cast("double"))
    of, part = cells.groupby(stratum, dropna=False).ngroup().to_numpy(), pd.factorize(cells[partition])[0]
    p = 1 / (1 + np.exp(-additive_logit(of, part, cells["positive"].to_numpy(np.float64), cells["support"].to_numpy(np.float64), c)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    known = rows.sparkSession.createDataFrame(cells[by].assign(_p=p, _d=np.sqrt(np.maximum(p * (1 - p), 1e-9))), f"{kinds}, _p double, _d double")
    return rows.join(F.broadcast(known), by).withColumn("residual", (F.col(label) - F.col("_p")) / F.col("_d")).drop("_p", "_d")
