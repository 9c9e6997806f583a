"""Quality classifier by positive-unlabelled learning (operator 8).

Trusted positives are the training fold's rows labelled 1; the other side is a sample of all documents
without any label. A small network on features of the whole text minimises the non-negative unbiased
risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)).
When a batch's bracket falls below zero, the step undoes that overfit instead of following it.

The class prior is estimated from the data: a first classifier tells positives from unlabelled, and on
rows that it hasn't seen the prior is the ratio of the unlabelled share to the positive share above a threshold,
at the threshold whose upper confidence bound on that ratio is least. Labels of 0 are never read.

Both samples are bounded and chosen by hash of the id (`MAX_POSITIVE`, `MAX_UNLABELLED`); every document
is scored on its whole text. All randomness is seeded.

Defined cases: null and empty texts have the features of no words and are scored like any other; without
positives or documents the score is 0.5 everywhere; repeated rows get the same score each; an empty
table gives an empty result; other columns pass through `with_quality`.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WHITE, bounded_batches, table

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
HIDDEN = 24
STEPS, BATCH = 1_500, 512
DECAY = 1e-4
#: Chance that the bound which picks the prior's threshold is missed.
PRIOR_RISK = 0.1
SEED = 8
SYMBOLS = b"#*$%&|<>"
N_FEATURES = 24


class Compressor:
    made: zstandard.ZstdCompressor | None = None


def features(text: str) -> list[float]:
    """Numbers that tell prose from junk in any language; all are bounded or logarithms."""
    data = text.encode("utf-8", "surrogatepass")
    n_bytes = len(data)
    if not n_bytes:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    far = hist[0xC0:].sum()  # characters outside ASCII
    of = lambda chars: hist[list(chars)].sum()
    words = data.split()
    n = max(1, len(words))
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    uses = np.bincount(ids) if len(ids) else np.zeros(1)
    pairs = ids[:-1] * n + ids[1:]
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n_lines = max(1, len(lines))
    ends = sum(x.rstrip(WHITE)[-1] in ".!?:;\"'" for x in lines)
    caps = sum(w[:1].isupper() for w in words)
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    short = int((sizes <= 2).sum())
    long_ = int((sizes >= 16).sum())
    Compressor.made = Compressor.made or zstandard.ZstdCompressor(level=1)
    packed = len(Compressor.made.compress(data))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(n_lines)),
        float(sizes.mean()) if len(words) else 0.0,
        float(sizes.std()) if len(words) else 0.0,
        upper / max(1, upper + lower),
        digits / n_bytes,
        far / n_bytes,
        min(2.0, of(SYMBOLS) / n),
        min(2.0, hist[33] / n),
        min(2.0, hist[124] / n),
        min(2.0, of(b".,;:?") / n),
        float(np.log1p(100 * of(SYMBOLS) / n_bytes)),
        len(first) / n,
        float(uses.max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        1 - len(np.unique(pairs)) / max(1, len(pairs)),
        1 - len(set(lines)) / n_lines,
        float(np.log1p(n / n_lines)),
        ends / n_lines,
        caps / n,
        shouted / n,
        short / n,
        long_ / n,
        packed / n_bytes / (1 + 200 / n_bytes),
    ]


class Net:
    """One hidden layer on standardised features; its output is the log-odds of quality."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> None:
        self.mean, self.scale = mean, scale
        k = len(mean)
        self.weights = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.t = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    def gradient(self, x: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        """Of a sum over rows, given its derivative by each row's log-odds."""
        a, b, c, _ = self.weights
        h = np.tanh(x @ a + b)
        dh = np.outer(dz, c) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        """Adam with weight decay."""
        self.t += 1
        for w, (m, v), g in zip(self.weights, self.moments, grads, strict=True):
            g = g + DECAY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of taking a row with log-odds z as 1; of taking it as 0 it is loss(-z)."""
    return np.logaddexp(0, -z)


def batches(n: int, size: int, steps: int, rng: np.random.Generator):
    """So many seeded samples of row numbers."""
    for _ in range(steps):
        yield rng.integers(0, n, min(n, size))


def class_prior(pos: np.ndarray, unl: np.ndarray, rng: np.random.Generator) -> float:
    """Share of positives among the unlabelled, from rows that the classifier hasn't seen.

    Above any threshold the share of the unlabelled over the share of the positives is the prior plus what negatives
    add. The threshold is the one with the least upper confidence bound on that ratio, so neither a thin tail (noise)
    nor a wide one (negatives) is taken; the estimate is the plain ratio there, without the bound's margin."""
    p, u = rng.permutation(len(pos)), rng.permutation(len(unl))
    fit_p, fit_u, new_p, new_u = pos[p[::2]], unl[u[::2]], pos[p[1::2]], unl[u[1::2]]
    if not len(new_p) or not len(new_u):
        return 0.5
    net = Net(unl.mean(0), unl.std(0) + 1e-3, rng)
    fit_p, fit_u = net.inputs(fit_p), net.inputs(fit_u)
    for i, j in zip(batches(len(fit_p), BATCH, STEPS // 3, rng), batches(len(fit_u), BATCH, STEPS // 3, rng), strict=True):
        a, b = fit_p[i], fit_u[j]
        ga = net.gradient(a, -sigmoid(-net.odds(a)) / len(a))
        gb = net.gradient(b, sigmoid(net.odds(b)) / len(b))
        net.step([x + y for x, y in zip(ga, gb, strict=True)], 0.01)
    sp, su = np.sort(net.odds(net.inputs(new_p))), np.sort(net.odds(net.inputs(new_u)))
    above_p = 1 - np.searchsorted(sp, sp, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    margin = np.sqrt(np.log(4 / PRIOR_RISK) / 2) * (np.sqrt(1 / len(sp)) + np.sqrt(1 / len(su)))
    at = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[at] / above_p[at], 0.05, 0.95))


class Model:
    """The trained network and the prior it was trained with."""

    def __init__(self, net: Net | None, prior: float) -> None:
        self.net, self.prior = net, prior

    @classmethod
    def learn(cls, pos: np.ndarray, unl: np.ndarray) -> Model:
        if not len(pos) or not len(unl):
            return cls(None, 0.5)
        rng = np.random.default_rng(SEED)
        prior = class_prior(pos, unl, rng)
        net = Net(unl.mean(0), unl.std(0) + 1e-3, rng)
        p, u = net.inputs(pos), net.inputs(unl)
        for step, (i, j) in enumerate(zip(batches(len(p), BATCH, STEPS, rng), batches(len(u), 2 * BATCH, STEPS, rng), strict=True)):
            a, b = p[i], u[j]
            za, zb = net.odds(a), net.odds(b)
            rest = loss(-zb).mean() - prior * loss(-za).mean()
            # Derivatives by the log-odds: loss(z)' = -sigmoid(-z), loss(-z)' = sigmoid(z).
            rest_a, rest_b = -prior * sigmoid(za) / len(a), sigmoid(zb) / len(b)
            if rest >= 0:
                ga, gb = net.gradient(a, -prior * sigmoid(-za) / len(a) + rest_a), net.gradient(b, rest_b)
            else:
                ga, gb = net.gradient(a, -rest_a), net.gradient(b, -rest_b)
            net.step([x + y for x, y in zip(ga, gb, strict=True)], 0.01 * (1 - step / STEPS) + 0.0005)
        net.moments = []
        return cls(net, prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.net is None else sigmoid(self.net.odds(self.net.inputs(x)))


def matrix(texts) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, N_FEATURES)


def measured(text: Column) -> Column:
    """The features of a text column."""
    bounded_batches()

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)), dtype=object)

    return measure(text)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from bounded samples of the training fold's positives and of all docs."""
    by_hash = lambda ids, most: ids.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(most).distinct()
    in_fold = F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(FOLDS)) != HELD_OUT
    trusted = labels.select(F.col(key).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_id").isNotNull() & (F.col("_y") == 1) & in_fold).select("_id")
    every = docs.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull())
    texts = docs.select(F.col(key).alias("_id"), F.col(text_col).alias("_text"))

    def rows(ids: DataFrame, most: int) -> np.ndarray:
        got = texts.join(F.broadcast(by_hash(ids, most)), "_id", "left_semi").select("_id", measured(F.col("_text")).alias("x")).orderBy("_id", "x").limit(2 * most).collect()
        return np.array([r["x"] for r in got], float).reshape(-1, N_FEATURES)

    return Model.learn(rows(trusted, MAX_POSITIVE), rows(every, MAX_UNLABELLED))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with the score in the column `into` (an own column of that name is replaced)."""
    bounded_batches()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return docs.withColumn(into, score(F.col(text_col)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, model).select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
