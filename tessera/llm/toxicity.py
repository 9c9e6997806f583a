"""Toxicity by nearest labelled examples (operator 6).

A text becomes a TF-IDF vector over every word of the labelled examples; document frequencies are counted over all
documents. A word's weight is (1 + log count) * IDF * surprise, where the surprise is how many standard deviations
(root of the log-likelihood ratio) its rates among toxic and other training examples lie apart, at least 1: no word
is left out, and one that the labels say nothing about keeps its plain TF-IDF weight. The score is a vote of the
nearest training examples by exact cosine, weighted by the cosine, then calibrated by isotonic regression on votes
that leave the example itself out; the nearest examples are kept as evidence.

The examples lie in an inverted index. The rarer words' postings are summed for every example. The common words (in over
`COMMON_SHARE` of the examples), whose postings would be most of the work, are columns of a matrix: what they add to the
cosines with all examples is one product for `BLOCK` documents. It is of single precision, so every example that comes
within its rounding of the k-th best cosine is computed once more in double precision, and the result is the same as that
of scoring every example on every word.

The labelled examples are a bounded sample, by hash of the id (`MAX_TOXIC`, `MAX_OTHER`); so the index that goes to the
tasks has a fixed bound. Every document is scored whole.

Defined cases: a text without a word of the examples (empty and null texts too) gets the rate of toxic
examples among training examples without one; no labels at all give score 0; conflicting labels of one
id each count; cosines that tie are ranked by the example's position in the index; repeated rows get the
same score each; an empty table gives an empty result; other columns pass through `with_toxicity`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, cut, own, table

WORD = re.compile(r"[^\W\d_]+")
#: Characters outside ASCII that aren't letters; and every ASCII byte that isn't a letter as a blank.
FAR_OTHER = re.compile(r"(?![\x00-\x7F])[\W\d]+")
ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MAX_TOXIC, MAX_OTHER = 3_000, 5_000
NEAREST = 15
#: Weight of the examples' toxic rate in a vote.
PRIOR_WEIGHT = 0.05
#: Documents that are multiplied by the examples' common words at once.
BLOCK = 32
COMMON_SHARE = 0.1
#: More than single precision can be off in a cosine.
SLACK = 1e-5
SEED = 6
FOLDS, HELD_OUT = 5, 0
SCORED = "score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"


def words_of(text: str) -> list[bytes]:
    """The lower-case runs of letters, in UTF-8: what WORD finds, cut as bytes, which takes a third of the time."""
    low = text.lower()
    if not low.isascii():
        low = FAR_OTHER.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(ONLY_LETTERS).split()


def terms(text: str) -> Counter:
    """The words of a text with their counts."""
    return Counter(words_of(text))


def ratio(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """Log-likelihood ratio of a of n against b of m."""

    def part(k, total, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(k > 0, k * np.log(p), 0.0)
            y = np.where(total - k > 0, (total - k) * np.log(1 - p), 0.0)
        return x + y

    if not n or not m:
        return np.zeros(len(a))
    a, b = a.astype(float), b.astype(float)
    both = (a + b) / (n + m)
    return np.maximum(0, 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, least x, largest x
    for i in order:
        pools.append([y[i], w[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [v for p in pools for v in (p[0], p[0])]
    return np.array(xs), np.array(ys)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Index:
    """Labelled examples as vectors of weighted words: postings of the rarer words, and a matrix of the common ones."""

    def __init__(self, vocabulary: dict[bytes, int], weight: np.ndarray, ids: Sequence[int], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], worth: tuple[float, float]) -> None:
        self.vocabulary, self.weight = vocabulary, weight
        labels = np.asarray(labels, float)
        every = np.where(labels > 0, worth[1], worth[0])
        bare = np.array([not len(at) for at, _ in vectors], bool)
        self.rate = float(every @ labels / every.sum()) if len(labels) else 0.0
        self.bare = float((every[bare] @ labels[bare] + self.rate) / (every[bare].sum() + 1)) if len(labels) else 0.0
        kept = np.flatnonzero(~bare).tolist()
        uses = np.bincount(np.concatenate([vectors[i][0] for i in kept]), minlength=len(vocabulary)) if kept else np.zeros(len(vocabulary))
        common = np.flatnonzero(uses > COMMON_SHARE * len(kept))
        self.column = np.full(len(vocabulary), -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = np.zeros((len(kept), len(common)), np.float32)
        for row, i in enumerate(kept):
            at, w = vectors[i]
            here = self.column[at]
            dense[row, here[here >= 0]] = w[here >= 0]
        first = dense.argmax(1) if len(common) else np.zeros(len(kept), np.int64)
        order = sorted(range(len(kept)), key=lambda r: (int(first[r]), len(vectors[kept[r]][0]), ids[kept[r]], int(labels[kept[r]])))
        kept = [kept[r] for r in order]
        self.dense = dense[order]
        del dense
        self.ids, self.labels, self.worth = np.array([ids[i] for i in kept], np.int64), labels[kept], every[kept]
        held = [vectors[i] for i in kept]
        rare = [self.column[v[0]] < 0 for v in held]
        words = np.concatenate([v[0][r] for v, r in zip(held, rare, strict=True)]).astype(np.int32) if held else np.empty(0, np.int32)
        by_word = np.argsort(words, kind="stable")
        self.word_start = np.searchsorted(words[by_word], np.arange(len(vocabulary) + 1))
        self.posted = np.repeat(np.arange(len(held), dtype=np.int32), [int(r.sum()) for r in rare])[by_word]
        self.posted_weight = np.concatenate([v[1][r] for v, r in zip(held, rare, strict=True)])[by_word] if held else np.empty(0)
        del words, by_word, rare
        votes = np.array([self.vote(*self.nearest(*v, without=p, common=c)) for p, (v, c) in enumerate(zip(held, self.common(held), strict=True))])
        self.knots = isotonic(votes, self.labels, self.worth) if held else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = terms(text)
        at = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), float, len(found))
        return weighted(at[at >= 0], counts[at >= 0], self.weight)

    def common(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """What the common words add to each vector's cosines with all examples, in single precision."""
        for a in range(0, len(vectors), BLOCK):
            some = vectors[a : a + BLOCK]
            queries = np.zeros((len(some), self.dense.shape[1]), np.float32)
            for row, (at, weight) in zip(queries, some, strict=True):
                column = self.column[at]
                row[column[column >= 0]] = weight[column >= 0]
            yield from queries @ self.dense.T

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEAREST, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, by cosine and then position; common: this vector's row of `common`."""
        size = len(self.ids)
        if not len(at) or not size:
            return np.empty(0, np.int64), np.empty(0)
        if common is None:
            (common,) = self.common([(at, weight)])
        column = self.column[at]
        rare = column < 0
        first = self.word_start[at[rare]]
        n = self.word_start[at[rare] + 1] - first
        posts = spread(first, n)
        partial = np.bincount(self.posted.take(posts), self.posted_weight.take(posts) * np.repeat(weight[rare], n), size)
        near = partial + common
        if without >= 0:
            near[without] = 0
        least = np.partition(near, size - k)[size - k] if size >= k else 0.0
        where = np.flatnonzero((near >= least - SLACK) & (near > 0))
        query = np.zeros(self.dense.shape[1])
        query[column[~rare]] = weight[~rare]
        exact = partial[where] + (self.dense[where] * query).sum(1)
        return best(where[exact > 0], exact[exact > 0], k)

    def vote(self, where: np.ndarray, cosine: np.ndarray) -> float:
        """Cosine-weighted share of toxic examples among the nearest, drawn to the overall rate."""
        w = cosine * self.worth[where]
        return float((w @ self.labels[where] + PRIOR_WEIGHT * self.rate) / (w.sum() + PRIOR_WEIGHT))

    def score(self, text: str) -> tuple[float, list[dict]]:
        return self.scores([text])[0]

    def scores(self, texts: Sequence[str]) -> list[tuple[float, list[dict]]]:
        """The score and the nearest examples of each text."""
        vectors = [self.vector(t) for t in texts]
        return [self._scored(*v, c) for v, c in zip(vectors, self.common(vectors), strict=True)]

    def _scored(self, at: np.ndarray, weight: np.ndarray, common: np.ndarray) -> tuple[float, list[dict]]:
        if not len(at):
            return self.bare, []
        where, cosine = self.nearest(at, weight, common=common)
        value = float(np.interp(self.vote(where, cosine), *self.knots))
        return min(1.0, max(0.0, value)), [{"doc_id": int(self.ids[p]), "cosine": float(c), "toxic": int(self.labels[p])} for p, c in zip(where[:3], cosine[:3], strict=True)]


def best(where: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of the highest cosine (to nine digits), then of the least position."""
    near = cosine.round(9)
    if len(near) > 4 * k:
        some = near >= -np.partition(-near, k - 1)[k - 1]
        where, cosine, near = where[some], cosine[some], near[some]
    order = np.lexsort((where, -near))[:k]
    return where[order], cosine[order]


def weighted(at: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights, of length 1, of the words at these places of the vocabulary; words of no weight are left out."""
    w = (1 + np.log(counts)) * weight[at]
    at, w = at[w > 0], w[w > 0]
    return at, w / np.sqrt(w @ w)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """The index of a bounded sample of the training fold's labelled rows, with IDF over all docs."""
    bounded_batches()
    usable = labels.select(F.col(key).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1))
    usable = usable.filter(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    of = {r[0]: r[1] for r in usable.groupBy("_toxic").count().collect()}
    by_hash = lambda toxic, most: usable.filter(F.col("_toxic") == toxic).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(most)
    some = by_hash(1, MAX_TOXIC).unionAll(by_hash(0, MAX_OTHER))

    @F.pandas_udf("struct<words:array<binary>,counts:array<int>>")
    def count_words(texts: pd.Series) -> pd.DataFrame:
        found = [terms(t or "") for t in texts]
        return pd.DataFrame({"words": [list(f) for f in found], "counts": [list(f.values()) for f in found]})

    # Distinct rows: a document that the corpus repeats is one example, and the limit above bounds what comes here.
    texts = cut(docs.select(F.col(key).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id").distinct())
    got = texts.select("_id", "_toxic", count_words(F.col("_text")).alias("f")).select("_id", "_toxic", "f.*").toArrow().combine_chunks()
    ids, toxic = np.array(got["_id"], np.int64), np.array(got["_toxic"], np.int64)
    counts, sizes = np.array(got["counts"].combine_chunks().flatten(), np.int32), np.diff(np.array(got["words"].combine_chunks().offsets))
    coded = got["words"].combine_chunks().flatten().dictionary_encode()
    names = coded.dictionary.to_pylist() if len(coded) else []
    # Numbered in the order of the words, whatever order the rows came in.
    place = {w: i for i, w in enumerate(sorted(names))}
    at = np.array([place[w] for w in names], np.int32)[np.array(coded.indices)] if names else np.empty(0, np.int32)
    del got, coded, names
    of_toxic = np.repeat(toxic.astype(bool), sizes)
    n, m = int(toxic.sum()), int(len(toxic) - toxic.sum())
    in_toxic = np.bincount(at[of_toxic], minlength=len(place)).astype(float) if len(place) else np.empty(0)
    in_all = np.bincount(at, minlength=len(place)).astype(float) if len(place) else np.empty(0)
    del of_toxic
    surprise = np.maximum(1, np.sqrt(ratio(in_toxic, in_all - in_toxic, n, m)))
    weight = inverse_frequencies(docs, text_col, place) * surprise
    ends = np.cumsum(sizes)
    vectors = [weighted(at[b - s : b], counts[b - s : b], weight) for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    del at, counts
    order = sorted(range(len(ids)), key=lambda i: (ids[i], toxic[i], sorted(vectors[i][0].tolist())))
    worth = (of.get(0, 0) / m if m else 1.0, of.get(1, 0) / n if n else 1.0)
    return Index(place, weight, [int(ids[i]) for i in order], toxic[order], [vectors[i] for i in order], worth)


def inverse_frequencies(docs: DataFrame, text_col: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """IDF of the vocabulary over all docs; each task sends one count for each word that it met."""
    if not vocabulary:
        return np.zeros(0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows, get = np.zeros(len(vocabulary) + 1, np.int64), 0, vocabulary.get
        for batch in batches:
            for text in batch["_text"]:
                rows += 1
                words = set(words_of(text or ""))
                seen[np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))] += 1  # the last place takes all other words
        met = np.flatnonzero(seen[:-1])
        yield pd.DataFrame({"at": np.concatenate(([-1], met)), "n": np.concatenate(([rows], seen[met]))})

    counted = docs.select(F.col(text_col).alias("_text")).mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[np.array(counted["at"], np.int64)] = np.array(counted["n"], float)  # the number of rows lies last
    return np.log((df[-1] + 1) / (df[:-1] + 1))


def with_toxicity(docs: DataFrame, index: Index, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct of score and evidence in the column `into` (an own column of that name is replaced)."""
    return docs.withColumn(into, scorer(index)(F.col(text_col)))


def scorer(index: Index):
    """The index as a column function of texts."""
    bounded_batches()

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = [row for a in range(0, len(texts), BLOCK) for row in index.scores([t or "" for t in texts.iloc[a : a + BLOCK]])]
        return pd.DataFrame(rows, columns=["score", "evidence"])

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""
    index = train(docs, labels, text_col=text_col)
    (into,) = own(docs, "_toxicity")
    return with_toxicity(docs, index, text_col, into).filter(F.col(f"{into}.score") < threshold).drop(into)


def op6_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = train(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs, index).select("doc_id", "toxicity.*")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"], F.round(e["cosine"], 4), e["toxic"])), ",")
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        evidence.alias("evidence"),
    )
