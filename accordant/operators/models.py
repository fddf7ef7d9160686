"""Held-out logistic comparisons over categorical columns.

The categories are one-hot columns of those that occur often enough in the training folds; others are none. A model is
fitted from counts: rows of equal categories and label are one weighted row, summed up in Spark, so the fit sees as many
rows as there are distinct combinations and not as there are observations. Ridge logistic regression (free intercept,
minimising half the squared weights plus C times the log loss) by Newton's steps, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept


def folds_by_hash(key: list[str], k: int = 5, seed: int = 0) -> Column:
    """A fold of each key: rows of one key stay together."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(k)).cast("int")


def greedy_runs(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Of each size (size, groups; by falling size) the runs of the greedy deal: from a rank on, a pattern of folds that repeats.

    The folds that get a group before the least loaded one would get its second take turns, until the next fold's load is reached; then they are
    one more. So a size has few runs, whatever its groups."""
    load, out = [0] * k, []
    for n, m in sizes:
        runs, rank = [], 0
        while rank < m:
            order = sorted(range(k), key=lambda f: (load[f], f))
            again = (load[order[0]] + n, order[0])
            turn = [f for f in order if (load[f], f) < again]
            others = [(load[f], f) for f in order if f not in turn]
            rounds = m
            for f in turn:
                for there, g in others:  # the greatest t with (load[f] + t * n, f) before (there, g), and one more
                    rounds = min(rounds, (there - load[f] - (f > g)) // n + 1)
            taken = min(m - rank, max(1, rounds) * len(turn))
            runs.append((rank, turn))
            for at, f in enumerate(turn):
                load[f] += n * ((taken - at + len(turn) - 1) // len(turn))
            rank += taken
        out.append((n, runs))
    return out


def folds_by_size(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """group and fold: the groups by falling size, of one size by name, go one after the other to the fold of fewest rows so far (the first of equals).

    The driver sees how many groups each size has (at most the square root of twice the rows) and deals them by runs. Groups get their rank within their size in
    ranges of (size, group), so that a size may have any number; a null group is one."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    dealt = kept(sizes.repartitionByRange(F.desc("_size"), F.asc(group)).withColumn("_part", F.spark_partition_id()), "groups")
    counts = dealt.groupBy("_size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.withColumn("_earlier", F.sum("_n").over(before)).filter("_earlier > 0").drop("_n")  # one a range
    rank = F.row_number().over(Window.partitionBy("_size", "_part").orderBy(group)) - 1
    ranked = dealt.withColumn("_rank", rank).join(F.broadcast(earlier), ["_size", "_part"], "left").withColumn("_rank", F.col("_rank") + F.coalesce("_earlier", F.lit(0)))
    runs = greedy_runs([(r[0], r[1]) for r in counts.groupBy("_size").agg(F.sum("_n")).orderBy(F.desc("_size")).collect()], k)
    table = df.sparkSession.createDataFrame(runs, "_size long, _runs array<struct<start:long,turn:array<int>>>")
    own = F.element_at(F.filter("_runs", lambda x: x["start"] <= F.col("_rank")), -1)
    fold = F.element_at(own["turn"], ((F.col("_rank") - own["start"]) % F.size(own["turn"]) + 1).cast("int"))
    return ranked.join(F.broadcast(table), "_size").select(group, fold.alias("fold"))


def ridge_logit(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.ones(x.shape[1] - 1), 0.0)
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return 0.5 * float(penalty @ b**2) + c * float(w @ (np.logaddexp(0, z) - y * z))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        gradient = penalty * beta + c * (x.T @ (w * (p - y)))
        hessian = np.diag(penalty) + c * (x.T * (w * p * (1 - p))) @ x
        try:
            move = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError:
            move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        scale, now = 1.0, loss(beta)
        while scale > 1e-8 and loss(beta - scale * move) > now:
            scale /= 2
        beta = beta - scale * move
        if np.abs(scale * move).max() < 1e-10:
            break
    return beta


def _one_hot(train: pd.DataFrame, test: pd.DataFrame, columns: list[str], min_frequency: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for c in columns:
        counts = train.groupby(c)["n"].sum()
        for v in sorted(counts.index[counts >= min_frequency]):
            left.append((train[c] == v).to_numpy(np.float64))
            right.append((test[c] == v).to_numpy(np.float64))
    return (np.stack(m, axis=1) if m else np.zeros((len(f), 0)) for m, f in ((left, train), (right, test)))


def out_of_fold(df: DataFrame, columns: list[str], label: str, fold: str = "fold", min_frequency: int = 10, c: float = 1.0, carry: tuple[str, ...] = (), rate: str | None = None) -> DataFrame:
    """fold, the columns, label (0 or 1), n and p: the held-out probability of each combination. Each fold is fitted by a task of its own.
    Columns to carry tell combinations apart and are no features; rate is one of all of them whose share of positives in the training folds is
    a feature (for a value that they lack, the share of all)."""
    kept = [*columns, *(x for x in carry if x not in columns)]
    counts = df.select(fold, *(F.coalesce(F.col(x).cast("string"), F.lit("na")).alias(x) for x in kept), F.col(label).cast("int").alias(label)).groupBy(fold, *kept, label).agg(F.count(F.lit(1)).alias("n"))
    folds = df.select(F.col(fold).alias("_held")).distinct()
    paired = counts.crossJoin(F.broadcast(folds))  # a row a combination and fold; folds are a handful

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([fold, *kept, label]).reset_index(drop=True)
        out = pdf[fold] == pdf["_held"]
        train, test = pdf[~out], pdf[out]
        a, b = _one_hot(train, test, columns, min_frequency)
        if rate and len(train):
            n, positive = (v.groupby(train[rate]).sum() for v in (train["n"], train["n"] * train[label]))
            share, overall = positive / n, positive.sum() / n.sum()
            a, b = (np.column_stack([m, f[rate].map(share).fillna(overall).to_numpy(np.float64)]) for m, f in ((a, train), (b, test)))
        beta = ridge_logit(a, train[label].to_numpy(np.float64), train["n"].to_numpy(np.float64), c) if len(train) else np.zeros(1)
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([b, np.ones(len(b))]) @ beta, -700, 700)))
        return test.assign(p=p)[[fold, *kept, label, "n", "p"]]

    schema = ", ".join([f"{fold} int", *(f"{x} string" for x in kept), f"{label} int", "n long", "p double"])
    return paired.groupBy("_held").applyInPandas(fit, schema)


def auc(df: DataFrame, by: list[str], score: str, label: str, weight: str) -> DataFrame:
    """Weighted area under the curve of each group, equal scores counting half; null where one class is missing."""
    per = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col(weight))).alias("_n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    area = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return ranked.groupBy(*by).agg((area / F.nullif((F.sum("_p") * F.sum("_n")).cast("double"), F.lit(0.0))).alias("auc"))


def log_loss(df: DataFrame, by: list[str], p: str, label: str, weight: str) -> DataFrame:
    safe = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    loss = -F.when(F.col(label) == 1, F.log(safe)).otherwise(F.log(1 - safe))
    return df.groupBy(*by).agg((F.sum(loss * F.col(weight)) / F.sum(weight)).alias("log_loss"))


def within_auc(df: DataFrame, by: list[str], partition: str, score: str, label: str, weight: str) -> DataFrame:
    """The areas within each partition, averaged by its weight; partitions of one class alone don't count."""
    sizes = df.groupBy(*by, partition).agg(F.sum(weight).alias("_w"))
    each = auc(df, [*by, partition], score, label, weight).join(sizes, [*by, partition]).filter("auc IS NOT NULL")
    return each.groupBy(*by).agg((F.sum(F.col("auc") * F.col("_w")) / F.sum("_w")).alias("auc_within"))


def fold_summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over folds, its standard error (0 for a single fold) and normal interval, and the number of folds that have a value."""
    mean, n = F.avg(value), F.count(value)
    se = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).when(n == 1, F.lit(0.0))
    return df.groupBy(*by).agg(mean.alias("mean"), se.alias("se"), (mean - 1.96 * se).alias("low"), (mean + 1.96 * se).alias("high"), n.alias("folds"))


def document_icc(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way intraclass correlation of a value by cluster, for unequal sizes, at least 0; and the deviation of a logit random intercept that
    has it. Clusters of one row tell nothing of it and count in the mean alone."""
    groups = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.sum(F.pow(value, F.lit(2))).alias("q"))
    many, n = F.col("n") > 1, F.col("n")
    of = lambda c: F.sum(F.when(many, c).otherwise(0))
    s = groups.agg(F.count_if(many).alias("k"), (F.sum(n * F.col("m")) / F.sum(n)).alias("g"), of(n).alias("n"), of(n * n).alias("nn"), of(n * F.col("m")).alias("t"), of(n * F.col("m") * F.col("m")).alias("b"), of(F.col("q")).alias("q"))
    between = (F.col("b") - 2 * F.col("g") * F.col("t") + F.col("g") * F.col("g") * F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0))
    within = (F.col("q") - F.col("b")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    size = (F.col("n") - F.col("nn") / F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0))
    icc = F.greatest(F.lit(0.0), (between - within) / F.nullif(between + (size - 1) * within, F.lit(0.0)))
    out = s.select(F.col("k").alias("clusters"), icc.alias("icc"))
    # The residual variance of a logit is pi squared over 3.
    return out.withColumn("sigma", F.sqrt(F.col("icc") / F.nullif(1 - F.col("icc"), F.lit(0.0)) * (F.lit(np.pi) ** 2 / 3)))


def auc_lift_bootstrap(scored: DataFrame, document: str, partition: str, base: str, other: str, label: str, n: int, seed: int) -> DataFrame:
    """replicate, scope and value, the gain in AUC of the score other over base, in n resamples of documents within partitions; nothing
    is refitted. The scope is raw (all rows), within (the gains within partitions, averaged by their rows), or a partition after `in `;
    where a resample has one class alone there is no row. scored is summed up to a row a document, pair of scores and label before the driver sees it."""
    from .resample import replicates

    rows = scored.groupBy(partition, document, base, other, label).agg(F.count(F.lit(1)).alias("n")).orderBy(partition, document, base, other, label).toPandas()
    owner = rows.groupby([partition, document], sort=True).ngroup().to_numpy()
    first = rows.assign(owner=owner).drop_duplicates("owner").sort_values("owner").reset_index(drop=True)
    clusters = [np.asarray(v) for v in first.groupby(partition).indices.values()]
    y, n_rows = rows[label].to_numpy(np.float64), rows["n"].to_numpy(np.float64)
    places = {s: np.unique(rows[s].to_numpy(), return_inverse=True) for s in (base, other)}
    names = sorted(rows[partition].unique())
    parts = [np.flatnonzero((rows[partition] == v).to_numpy()) for v in names]

    def area(s: str, w: np.ndarray, some: np.ndarray | slice = slice(None)) -> float:
        values, at = places[s]
        p, q = np.bincount(at[some], (w * y)[some], len(values)), np.bincount(at[some], (w * (1 - y))[some], len(values))
        total = p.sum() * q.sum()
        return float((p * (np.cumsum(q) - q / 2)).sum() / total) if total else float("nan")

    def draw(i: int) -> dict[str, float]:
        rng = np.random.default_rng([seed, i])
        times = np.zeros(len(first))
        for c in clusters:
            times[c] = np.bincount(rng.integers(0, len(c), len(c)), minlength=len(c))
        w = times[owner] * n_rows
        gains = np.array([area(other, w, r) - area(base, w, r) for r in parts])
        weights = np.where(np.isnan(gains), 0.0, [w[r].sum() for r in parts])
        within = float(np.nansum(gains * weights) / weights.sum()) if weights.sum() else float("nan")
        return {"raw": area(other, w) - area(base, w), "within": within} | {f"part{k}": float(g) for k, g in enumerate(gains)}

    columns = {"raw": "raw", "within": "within"} | {f"part{k}": f"in {v}" for k, v in enumerate(names)}
    drawn = replicates(scored.sparkSession, n, draw, ", ".join(f"{x} double" for x in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("scope"), F.col(x).alias("value")) for x, v in columns.items())))
    return drawn.select("replicate", pairs.alias("s")).select("replicate", "s.scope", "s.value").filter("value IS NOT NULL AND NOT isnan(value)")


def additive_null(cells: DataFrame, stratum: list[str], partition: str, n: int, seed: int, sigma: float = 0.0, c: float = 1.0) -> DataFrame:
    """replicate and value, the mean gap between partitions under a model in which partition and stratum add up on the logit scale:
    fitted to the cells, then drawn from, n times; with sigma each cell's logit moves by a normal draw of that deviation first."""
    from .resample import _cells, mean_gap, replicates

    rows = cells.orderBy(*stratum, partition).toPandas().reset_index(drop=True)
    names = rows[stratum].astype(str).agg("\x1f".join, axis=1)
    x = np.concatenate([pd.get_dummies(names).to_numpy(np.float64), pd.get_dummies(rows[partition].astype(str)).to_numpy(np.float64)], axis=1) if len(rows) else np.zeros((0, 0))
    support, positive = rows["support"].to_numpy(np.float64), rows["gold_positive"].to_numpy(np.float64)
    twice, y, w = np.concatenate([x, x]), np.repeat([1.0, 0.0], len(rows)), np.concatenate([positive, support - positive])
    beta = ridge_logit(twice, y, w, c) if len(rows) else np.zeros(1)
    logit = np.column_stack([x, np.ones(len(rows))]) @ beta if len(rows) else np.zeros(0)
    gap, size = mean_gap(_cells(rows, stratum)), support.astype(np.int64)

    def draw(i: int) -> dict[str, float]:
        rng = np.random.default_rng([seed, i])
        moved = logit + (rng.normal(0, sigma, len(logit)) if sigma else 0.0)
        return {"value": gap(rng.binomial(size, 1 / (1 + np.exp(-moved))), support)}

    return replicates(cells.sparkSession, n, draw, "value double")


def words_of(text: Column, stop: list[str]) -> Column:
    """Distinct lower-cased words of two letters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0))
    return F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>"))


def vocabulary(df: DataFrame, words: str, min_documents: int = 10, most: int = 800) -> DataFrame:
    """word, documents and place of the most frequent words that enough rows have; ties by word. Counted over the rows given."""
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= min_documents)
    top = counts.orderBy(F.desc("documents"), "word").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("documents"), "word")) - 1)  # at most `most` rows


class _Descent:
    """Steps of L-BFGS down a convex loss from zero, its first guess at the inverse Hessian a matrix of some coordinates and a diagonal of the
    others. The loss is asked for elsewhere: `at` is the point, `told` takes its loss and gradient there and says whether it is the minimum."""

    def __init__(self, inverse: np.ndarray, dense: np.ndarray, diagonal: np.ndarray, memory: int = 30):
        self.inverse, self.dense, self.diagonal, self.memory = inverse, dense, diagonal, memory
        self.at, self.past = np.zeros(len(diagonal)), []  # past: pairs of moves and changes of the gradient
        self.here = None

    def _solved(self, v: np.ndarray) -> np.ndarray:
        out = v * self.diagonal
        out[self.dense] = (self.inverse * v[self.dense]).sum(axis=1)
        return out

    def told(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        if self.here is not None:
            x, before, g, move = self.here
            slope = float(g @ move)
            if loss > before + 1e-4 * self.scale * slope + 1e-12 * abs(before) and self.scale > 1e-10:
                self.scale /= 2
                self.at = x + self.scale * move
                return False
            s, y = self.at - x, gradient - g
            if s @ y > 0:
                self.past = [*self.past, (s, y)][-self.memory :]
        if float(gradient @ self._solved(gradient)) <= tolerance:
            return True
        q, parts = gradient.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            parts.append(a)
        q = self._solved(q)
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ self._solved(y))
        for (s, y), a in zip(self.past, reversed(parts)):
            q += (a - (y @ q) / (s @ y)) * s
        self.here, self.scale = (self.at, loss, gradient, -q), 1.0
        self.at = self.at - q
        return False


#: Rows of a block, which is made a dense matrix while it is looked at.
_BLOCK = 1024
#: A fit ends where its steps would lower the whole loss by less than half of this.
_TOLERANCE = 1e-10
_BLOCKS = "fold int, n int, y binary, rows binary, places binary, categories binary"


def _vocabularies(rows: DataFrame, folds: list[int], min_documents: int, most: int) -> dict[int, list[str]]:
    """Of rows of fold and words: each fold's vocabulary, counted over the others in one pass for all."""
    counts = rows.select("fold", F.explode("words").alias("word")).groupBy("word").agg(F.count("fold").alias("all"), *(F.count_if(F.col("fold") == r).alias(f"in{i}") for i, r in enumerate(folds)))
    counts = counts.filter(F.col("all") >= min_documents).persist()
    out = {}
    for i, r in enumerate(folds):
        n = F.col("all") - F.col(f"in{i}")
        out[r] = [x["word"] for x in counts.filter(n >= min_documents).orderBy(n.desc(), "word").limit(most).collect()]  # bounded by most
    counts.unpersist()
    return out


def text_models(df: DataFrame, words: str, label: str, fold: str, models: dict[str, list[str]], c: float = 1.0, steps: int = 3000, min_documents: int = 10, most: int = 800) -> DataFrame:
    """model, fold, label and p: held-out probabilities of ridge logits over words and each model's one-hot columns, fitted to convergence (an
    error after that many steps without). Each fold's vocabulary is counted over its training folds alone; a category that these lack has no
    weight. Where they have one label alone it is certain; a lone fold has no p.

    The fits of all models and folds take their steps together, so that a step is one pass over the rows, which stay where they are as
    blocks of feature numbers; the driver sees losses and gradients, a row a partition. Steps are scaled by the bound of the Hessian that the words'
    joint counts give, for which there is one pass more."""
    spark, kind = df.sparkSession, {x: df.schema[x].dataType for x in (fold, label)}
    columns = list(dict.fromkeys(x for xs in models.values() for x in xs))
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("y"), F.coalesce(words, F.array()).alias("words"), *(F.coalesce(F.col(x).cast("string"), F.lit("na")).alias(f"c{i}") for i, x in enumerate(columns)))
    rows = kept(rows.filter("fold IS NOT NULL"), "texts")
    share = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "y").count().collect()}  # a handful of folds
    folds = sorted({f for f, _ in share})
    terms = _vocabularies(rows, folds, min_documents, most)
    known = sorted({w for v in terms.values() for w in v})
    number, n_words = {w: i for i, w in enumerate(known)}, len(known)
    # Features: the words, the intercept, the categories of each column.
    size, start = n_words + 1, []
    categories = [sorted(x[0] for x in rows.select(f"c{i}").distinct().collect()) for i in range(len(columns))]
    for values in categories:
        start.append(size)
        size += len(values)

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            place = pc.index_in(b.column(2).flatten(), value_set=pa.array(known, b.column(2).type.value_type))
            length = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), length)[place >= 0]
            place = place[place >= 0]
            own = np.zeros((len(b), len(columns)), dtype=np.int32)
            for i, values in enumerate(categories):
                own[:, i] = start[i] + pc.index_in(b.column(3 + i), value_set=pa.array(values, b.column(3 + i).type)).to_numpy(zero_copy_only=False)
            of, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(of):
                mine = np.flatnonzero(of == f)
                for a in range(0, len(mine), _BLOCK):
                    some = mine[a : a + _BLOCK]
                    new = np.full(len(b), -1, dtype=np.int32)
                    new[some] = np.arange(len(some))
                    at = new[row]
                    values = [[int(f)], [len(some)], *([v.tobytes()] for v in (y[some].astype(np.int32), at[at >= 0], place[at >= 0].astype(np.int32), own[some]))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["fold", "n", "y", "rows", "places", "categories"])

    blocks = kept(rows.mapInArrow(packed, _BLOCKS), "blocks")
    together = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def matrices(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Fold, labels, words with the intercept, and categories of each block."""
        for b in it:
            for r in b.to_pylist():
                y, at, place, own = (np.frombuffer(r[k], dtype=np.int32) for k in ("y", "rows", "places", "categories"))
                x = np.zeros((r["n"], n_words + 1))
                x[at, place] = 1
                x[:, n_words] = 1
                yield r["fold"], y, x, own.reshape(r["n"], -1)

    def sums(work: Callable, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of what work adds to zeros, block by block: in tasks, then over tasks."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for block in matrices(it):
                work(total, *block)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        out = np.zeros(shape)
        for r in together.mapInArrow(run, "total binary").collect():  # a row a partition
            out += np.frombuffer(r[0]).reshape(shape)
        return out

    fits = [(m, r) for m in models for r in folds]
    train = {r: {y: sum(n for (f, v), n in share.items() if f != r and v == y) for y in (0, 1)} for r in folds}
    fixed = {r: (None if not sum(t.values()) else float(t[1] > 0)) for r, t in train.items() if not all(t.values())}

    def pairs(total: np.ndarray, _fold: int, _y: np.ndarray, x: np.ndarray, _own: np.ndarray) -> None:
        total += x.T @ x

    def counted(total: np.ndarray, _fold: int, _y: np.ndarray, _x: np.ndarray, own: np.ndarray) -> None:
        total += np.bincount(own.ravel(), minlength=size)

    joint = sums(pairs, (n_words + 1, n_words + 1)) if folds else None
    often = sums(counted, (size,)) if columns else np.zeros(size)

    penalty, descents, used = np.ones(size), {}, {}
    penalty[n_words] = 0.0
    dense = {r: np.append(np.array([number[w] for w in terms[r]], dtype=np.int64), n_words) for r in folds if r not in fixed}

    def inverted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.column(0).to_pylist():
                own = np.linalg.inv(c * joint[np.ix_(dense[r], dense[r])] / 4 + np.diag(penalty[dense[r]]))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["fold", "inverse"])

    of_folds = spark.createDataFrame([(r,) for r in dense], "fold int").repartition(max(1, len(dense)), "fold")
    inverses = {r: np.frombuffer(own).reshape(len(dense[r]), -1) for r, own in of_folds.mapInArrow(inverted, "fold int, inverse binary").collect()}  # a handful of folds, each bounded by most
    for r, inverse in inverses.items():
        for m, xs in models.items():
            mask = np.zeros(size)
            mask[dense[r]] = 1
            for x in xs:
                i = columns.index(x)
                mask[start[i] : start[i] + len(categories[i])] = 1
            used[m, r] = mask
            descents[m, r] = _Descent(inverse, dense[r], mask / (1 + c * often / 4))

    def logits(beta: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        z = x @ beta[: n_words + 1]
        for i in range(len(columns)):
            z += beta[own[:, i]]
        return z

    moving, took = list(descents), 0
    while moving:
        if took == steps:
            raise RuntimeError(f"the fits of {moving} have not converged in {steps} steps")
        beta, of = np.stack([descents[k].at for k in moving], axis=1), np.array([r for _, r in moving])

        def slopes(total: np.ndarray, f: int, y: np.ndarray, x: np.ndarray, own: np.ndarray, beta: np.ndarray = beta, of: np.ndarray = of) -> None:
            """Log loss, in the first row, and its gradient, of the fits that f is a training fold of."""
            some = np.flatnonzero(of != f)
            z = logits(np.ascontiguousarray(beta[:, some]), x, own)
            total[0, some] += (np.logaddexp(0, z) - y[:, None] * z).sum(axis=0)
            rest = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[:, None]
            total[1 : n_words + 2, some] += x.T @ rest
            for i in range(len(columns)):
                by = np.zeros((size + 1, len(some)))
                np.add.at(by, own[:, i] + 1, rest)
                total[:, some] += by

        out, left = sums(slopes, (size + 1, len(moving))), []
        for j, k in enumerate(moving):
            loss = 0.5 * float(penalty @ beta[:, j] ** 2) + c * out[0, j]
            if not descents[k].told(loss, used[k] * (penalty * beta[:, j] + c * out[1:, j]), _TOLERANCE):
                left.append(k)
        moving, took = left, took + 1

    def held(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, y, x, own in matrices(it):
            for m in models:
                p = np.full(len(y), np.nan if fixed.get(f) is None else fixed[f]) if f in fixed else 1 / (1 + np.exp(-np.clip(logits(final[m, f], x, own), -700, 700)))
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(y)), pa.array(np.full(len(y), f, dtype=np.int32)), pa.array(y), pa.array(p, from_pandas=True)], names=["model", "fold", "y", "p"])

    final = {k: d.at for k, d in descents.items()}
    out = blocks.mapInArrow(held, "model string, fold int, y int, p double")
    return out.select("model", F.col("fold").cast(kind[fold]).alias(fold), F.col("y").cast(kind[label]).alias(label), "p")


def text_model(df: DataFrame, words: str, label: str, fold: str, columns: list[str], **named: float) -> DataFrame:
    """fold, label and p of one of `text_models`."""
    return text_models(df, words, label, fold, {"": columns}, **named).drop("model")
