"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Features are the byte n-grams (2 to 4) of the lower-cased text in which every ASCII character that is no letter becomes
a space; each is hashed to one of BUCKETS embeddings. A text is the average of its embeddings; a linear softmax gives
the languages. Embeddings and weights are trained together by stochastic gradient descent in numpy on at most
TRAIN_ROWS documents (the bound of the sample; the eligible rows of least hash) and on short word runs cut from them,
so that short texts are met in training too. Three tenths of the sample are set aside. On them a temperature is fitted, and then
the rejection: the calibrated probability that all but REJECTED of the set-aside examples give to their true language. A prediction
below it is less sure than texts of the known languages are, and is rejected.

For prediction the embeddings fold into one table of logits a bucket, in fixed point, so that sums are exact and equal
texts get equal scores. Prediction reads the text alone and runs over every whole text in one pass without a shuffle.

A null text, or one without a letter (Unicode's category L; numerals are none), gets `und` with score 0 and is rejected, an empty one
too. Without eligible rows every text gets `und`, and the stage of a pipeline, which has nothing to reject by then, keeps all rows. Of languages with equal probability the first by name is given. A text of any
length is read whole; a text longer than a batch of features stands in one alone. Repeated rows each get their result, equal texts
equal ones; rows without an id are predicted but never learnt from. An empty table gives an empty table. Columns of the computed names
(lang_pred, score, accepted) are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BUCKETS = 1 << 15
DIMENSION = 16
TRAIN_ROWS = 3000
#: Passes over the sample, and more where they would make fewer steps than STEPS.
EPOCHS, STEPS = 4, 8000
RATE = 2.0
SIZES = (2, 3, 4)
#: Share of the set-aside examples whose true language may have a probability below the fitted rejection.
REJECTED = 0.005
FIXED = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages), fixed point
    temperature: float
    least: float  # a prediction of a lower probability is rejected


def grams(raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and bucket of the n-grams of a byte array, of each size; none has a space within or is only spaces."""
    wide, space = raw.astype(np.uint32), raw == 0x20
    out = []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ wide[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        good = ~(space[:m] & space[n - 1 :])
        for k in range(1, n - 1):
            good &= ~space[k : k + m]
        at = np.flatnonzero(good)
        out.append((at, (h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)))
    return out


def normalised(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    found = grams(_CLASS[np.frombuffer(normalised(text), dtype=np.uint8)])
    return np.unique(np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint32), return_counts=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(texts: list[str], labels: list[str], languages: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Embeddings and weights by stochastic gradient descent, and the examples set aside (all, if there are too few to set any aside)."""
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    n_fit = max(1, len(texts) * 7 // 10)

    def examples(rows: range) -> list[tuple[np.ndarray, np.ndarray, int]]:
        made = []
        for i in rows:
            words = texts[i].split()
            size = int(rng.integers(3, 40))
            cut = int(rng.integers(0, max(1, len(words) - size)))
            for part in (texts[i], " ".join(words[cut : cut + size])):
                idx, n = features(part)
                if len(idx):
                    made.append((idx, (n / n.sum()).astype(np.float32), number[labels[i]]))
        return made

    fit, held = examples(range(n_fit)), examples(range(n_fit, len(texts)))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    weights = np.zeros((DIMENSION, len(languages)), dtype=np.float32)
    passes = max(EPOCHS, -(-STEPS // max(1, len(fit))))
    step, steps = 0, max(1, passes * len(fit))
    for _ in range(passes):
        for j in rng.permutation(len(fit)):
            idx, share, y = fit[j]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = share @ table[idx]
            p = _softmax(mean @ weights)
            p[y] -= 1
            back = weights @ p
            weights -= rate * 0.1 * np.outer(mean, p)
            table[idx] -= rate * share[:, None] * back
    return table, weights, held or fit


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    languages = sorted(set(labels))
    table, weights, held = descend(texts, labels, languages, seed)
    logits = table @ weights
    raw = np.array([share @ logits[idx] for idx, share, _ in held] or [np.zeros(len(languages))])
    truth = np.array([y for *_, y in held] or [0])
    # The temperature of least log loss on what was set aside.
    right = lambda t: _softmax(raw / t)[np.arange(len(truth)), truth]
    grid = 2.0 ** np.arange(-5, 3, 0.25)
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(right(t), 1e-12)).mean()))
    return Model(languages, np.rint(logits.astype(np.float64) * FIXED).astype(np.int64), temperature, float(np.quantile(right(temperature), REJECTED, method="lower")))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(texts)
    lang, score = ["und"] * n, np.zeros(n)
    known = [i for i, x in enumerate(texts) if x and _LETTER.search(x)] if model and model.languages else []
    raw = [normalised(texts[i]) for i in known]
    for a, b in C.chunks([len(x) for x in raw], 1 << 19):
        joined = _CLASS[np.frombuffer(b"".join(raw[a:b]), dtype=np.uint8)]
        # Each text begins and ends with a space: n-grams over the joint have a space within, but for those of two bytes, which are only spaces.
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw[a:b]])])
        total, count = np.zeros((b - a, len(model.languages)), dtype=np.int64), np.zeros(b - a, dtype=np.int64)
        for at, bucket in grams(joined):
            cuts = np.searchsorted(at, bounds)
            count += np.diff(cuts)
            for k in range(len(model.languages)):
                sums = np.concatenate([[0], np.cumsum(model.logits[:, k][bucket])])
                total[:, k] += np.diff(sums[cuts])
        p = _softmax(total / np.maximum(count, 1)[:, None] / FIXED / model.temperature)
        best = p.argmax(axis=1)
        for j in range(a, b):
            lang[known[j]] = model.languages[best[j - a]]
        score[known[a:b]] = p[np.arange(b - a), best]
    return lang, score, (score >= (model.least if model else 0)) & np.array([x != "und" for x in lang], dtype=bool)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5. Rows without an id are kept from it too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most rows labelled rows outside the held-out fold: those of least hash of their id, of one id those of least
    hash of their text. Rows are thinned by the hash of their id before any is sorted, so that hardly more than these are moved."""
    ready = df.filter(~held_out() & F.col("lang").isNotNull()).withColumn("_h", F.xxhash64("doc_id", F.lit(17)))
    order = ["_h", F.xxhash64("text"), "lang"]

    def least(some: DataFrame) -> list:
        return some.filter(F.col("text").rlike(r"\p{L}")).select("text", "lang", *order[:1]).orderBy(*order).limit(rows).collect()

    share = 4 * rows / max(1, ready.select("_h").count())
    got = least(ready.filter(F.col("_h") < int((share - 0.5) * 2**64))) if share < 1 else least(ready)
    if share < 1 and len(got) < rows:  # few ids, or few texts with a letter, below the cut
        got = least(ready)
    return train([r.text for r in got], [r.lang for r in got]) if got else None


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """df with the columns of FIELDS for its column text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the input

    def batch(b: pa.RecordBatch) -> list:
        lang, score, accepted = predict(shared.value, C.texts_of(b))
        return [pa.array(lang, pa.string()), score, accepted]

    return C.with_columns(df, batch, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


@C.protected
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose prediction is rejected go; without labels to learn from none is."""
    columns, model = docs.columns, fit(docs)
    return identify(docs, model).filter("accepted").select(*(F.col(f"`{c}`") for c in columns)) if model else docs
