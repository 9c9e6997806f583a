"""Evaluation: two-level means, intervals, pairs and votes, ranking measures, neighbours, representations."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import numbers as N
from tessera.functions import text as T


def behaviour(df: DataFrame, by: Sequence[str], numbers: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Means of finite numbers and rates of flags."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(N.finite(F.col(c).cast("double"))).alias(f"mean_{c}") for c in numbers], *[F.avg(F.col(c).cast("int")).alias(f"rate_{c}") for c in flags])


def two_level_means(df: DataFrame, group: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean of the clusters' means: every cluster weighs the same."""
    inner = df.groupBy(*group, cluster).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*group).agg(F.avg("_m").alias("mean"), F.count("*").alias("clusters"))


def paired(df: DataFrame, state: str, on: Sequence[str], left: str, right: str, value: str) -> DataFrame:
    """Differences of two states over the same cells; a cell that only one state has is an error."""
    a = df.filter(F.col(state) == left).select(*on, F.col(value).alias("_l"))
    b = df.filter(F.col(state) == right).select(*on, F.col(value).alias("_r"))
    held = a.join(b, list(on), "full_outer")
    whole = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("a cell lacks one of the states")).isNull()
    return held.filter(whole).select(*on, F.col("_l").alias(left), F.col("_r").alias(right), (F.col("_r") - F.col("_l")).alias("delta"))


def grid_gaps(df: DataFrame, state: str, on: Sequence[str]) -> DataFrame:
    """Cells that not all states have."""
    states = df.agg(F.count_distinct(state).alias("_n"))
    return df.groupBy(*on).agg(F.count_distinct(state).alias("states")).crossJoin(F.broadcast(states)).filter("states < _n").drop("_n")


def bootstrap(df: DataFrame, group: str, cluster: str, value: str, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(group, mean, low, high): clusters resampled with replacement by Python's seeded generator.

    Each group's fold sees cluster means only, so its size is the number of clusters."""
    means = df.groupBy(group, cluster).agg(F.avg(value).alias("_m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf.sort_values(cluster)["_m"].tolist()
        rng, n = random.Random(seed), len(held)
        got = sorted(sum(held[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
        at = lambda p: got[int(p * (draws - 1))]
        return pd.DataFrame([(pdf[group].iloc[0], sum(held) / n, at((1 - level) / 2), at((1 + level) / 2))], columns=[group, "mean", "low", "high"])

    return means.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, mean double, low double, high double")


def majority(votes: DataFrame, pair: str, preference: str, least: int = 2) -> DataFrame:
    """(pair, majority, unanimous): A or B with enough votes, else no_majority."""
    a, b = F.count_if(F.col(preference) == "A"), F.count_if(F.col(preference) == "B")
    out = F.when(a >= least, "A").when(b >= least, "B").otherwise("no_majority")
    return votes.groupBy(pair).agg(out.alias("majority"), ((a == F.count("*")) | (b == F.count("*"))).alias("unanimous"), F.count("*").alias("votes"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of equal labels over rows that have both."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties a half: by ranks, not by pairs.

    Ranks come from counts of each distinct score, so equal scores are one row."""
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    below = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    held = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    pairs = F.sum("_p") * F.sum("_n")
    return held.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), (wins / F.nullif(pairs, F.lit(0))).alias("auroc"))


def concordance(df: DataFrame, score: str, quality: str) -> DataFrame:
    """One row: over pairs of unequal quality, the share whose scores agree in order, ties a half.

    Distinct (score, quality) values with their counts meet each lower quality level once, and running counts by score do the
    rest; so the work is values times levels, not values squared."""
    held = df.filter(F.col(score).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(score).alias("s"), F.col(quality).alias("q")).agg(F.count("*").alias("n"))
    levels = held.select(F.col("q").alias("_level")).distinct()
    upper = held.join(F.broadcast(levels), F.col("q") > F.col("_level")).groupBy("s", "_level").agg(F.sum("n").alias("_a"))
    lower = held.select("s", F.col("q").alias("_level"), F.col("n").alias("_b"))
    cells = upper.join(lower, ["s", "_level"], "full_outer").select("s", "_level", F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    below = F.coalesce(F.sum("_b").over(W.partitionBy("_level").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = cells.withColumn("_below", below).groupBy("_level").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.col("_a") * (F.col("_below") + F.col("_b") / 2)).alias("_wins"))
    pairs = F.sum(F.col("_a") * F.col("_b"))
    return each.agg(pairs.alias("pairs"), (F.sum("_wins") / F.nullif(pairs, F.lit(0))).alias("concordance"))


def top_k_cosine(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(query, neighbour, cosine, rank): exact nearest vectors, a row itself left out, ties to the least id.

    The queries are packed into blocks of bounded size and every block meets every partition of the base
    in numpy; each task keeps k for each query, so what is sorted afterwards is k rows for each task and query."""
    kind = dict(base.dtypes)[key]
    q = queries.select(F.col(key).alias("_q"), F.col(vector).alias("_v")).withColumn("_b", F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-queries.count() // block)))))
    blocks = q.groupBy("_b").agg(F.collect_list(F.struct("_q", "_v")).alias("_qs"))
    packed = base.select(F.col(key).alias("_k"), F.col(vector).alias("_v"), F.spark_partition_id().alias("_p"), F.floor(F.monotonically_increasing_id() / 4096).alias("_c"))
    chunks = packed.groupBy("_p", "_c").agg(F.collect_list(F.struct("_k", "_v")).alias("_ks"))

    def run(batches):
        for batch in batches:
            for qs, ks in zip(batch["_qs"], batch["_ks"], strict=True):
                a, b = np.array([x["_v"] for x in qs], float), np.array([x["_v"] for x in ks], float)
                na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    sims = (a @ b.T) / na[:, None] / nb[None, :]
                ids = np.array([x["_k"] for x in ks])
                out = []
                for i, x in enumerate(qs):
                    s = np.where((ids == x["_q"]) | ~np.isfinite(sims[i]), -2.0, sims[i])
                    for j in np.lexsort((ids, -s))[:k]:
                        if s[j] > -2:
                            out.append((x["_q"], ids[j], float(s[j])))
                yield pd.DataFrame(out, columns=["query", "neighbour", "cosine"])

    near = chunks.crossJoin(blocks).select("_qs", "_ks").mapInPandas(run, f"query {kind}, neighbour {kind}, cosine double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def label_agreement(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row: the share of neighbours that have the query's label."""
    a = labels.select(F.col(key).alias("query"), F.col(label).alias("_a"))
    b = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_b"))
    return agreement(neighbours.join(a, "query").join(b, "neighbour"), "_a", "_b")


def pair_candidates(df: DataFrame, prompt: str, key: str, recipe: str, salt: str, cross: bool = True) -> DataFrame:
    """(prompt, a, b): one pair for each prompt, of different recipes or of the same, the first in hash order."""
    side = lambda n: df.select(prompt, F.col(key).alias(n), F.col(recipe).alias(f"_{n}"))
    pairs = side("a").join(side("b"), prompt).filter("a < b").filter(F.col("_a") != F.col("_b") if cross else F.col("_a") == F.col("_b"))
    order = T.sha(F.concat(F.lit(salt + "|"), F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string")))
    rank = F.row_number().over(W.partitionBy(prompt).orderBy(order, "a", "b"))
    return pairs.withColumn("_r", rank).filter("_r = 1").select(prompt, "a", "b")


def greedy_pairs(pairs: DataFrame, prompt: str, limit: int, salt: str) -> DataFrame:
    """(prompt, a, b): up to `limit` pairs of a prompt in hash order, no row used twice: a fold over one prompt."""
    kinds = dict(pairs.dtypes)
    order = T.sha(F.concat(F.lit(salt + "|"), F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for r in pdf.sort_values(["_h", "a", "b"]).itertuples():
            if len(out) < limit and r.a not in used and r.b not in used:
                used |= {r.a, r.b}
                out.append((pdf[prompt].iloc[0], r.a, r.b))
        return pd.DataFrame(out, columns=[prompt, "a", "b"])

    return pairs.withColumn("_h", order).groupBy(prompt).applyInPandas(fold, f"{prompt} {kinds[prompt]}, a {kinds['a']}, b {kinds['b']}")


def complete_votes(pairs: DataFrame, judges: DataFrame, votes: DataFrame, pair: str, judge: str) -> DataFrame:
    """Expected (pair, judge) cells without a vote. pairs x judges is small by its nature: judges are a handful."""
    return pairs.select(pair).crossJoin(F.broadcast(judges.select(judge))).join(votes, [pair, judge], "left_anti")


def best_and_final(df: DataFrame, run: str, update: str, loss: str) -> DataFrame:
    """The row with the least loss (the first of ties) and the last row of each history."""
    row = F.struct(update, loss)
    return df.groupBy(run).agg(F.min_by(row, F.struct(F.col(loss), F.col(update))).alias("best"), F.max_by(row, F.col(update)).alias("final"))


def best_fit(df: DataFrame, fits: Column, speed: str, cost: str) -> DataFrame:
    """The fastest row that fits, ties to the cheaper; none: no row."""
    return df.filter(fits).orderBy(F.desc(speed), cost).limit(1)


def linear_cka(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two representations of the same rows."""
    a, b = a - a.mean(0), b - b.mean(0)
    cross = np.linalg.norm(a.T @ b) ** 2
    return float(cross / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b)))


def effective_rank(a: np.ndarray) -> float:
    """Exponential of the entropy of the singular values' shares."""
    return rank_of_spread((a - a.mean(0)).T @ (a - a.mean(0)))


def rank_of_spread(gram: np.ndarray) -> float:
    """The same from the centred vectors' Gram matrix, whose eigenvalues are the singular values squared."""
    s = np.sqrt(np.clip(np.linalg.eigvalsh(gram), 0, None))
    p = s / max(s.sum(), 1e-300)
    p = p[p > 1e-9]
    return float(np.exp(-(p * np.log(p)).sum()))


def representation(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, effective_rank, rows) of each group's vectors: every batch gives its counts, sums and Gram matrix, which are
    added up; so a group of any size is a few matrices of the vectors' width."""
    kind = dict(df.dtypes)[group]

    def sums(batches):
        for batch in batches:
            held = batch[batch[vector].notna()]
            for name, rows in held.groupby(group, dropna=False):
                a = np.array(rows[vector].tolist(), float)
                yield pd.DataFrame({group: [name], "_n": [len(a)], "_sum": [a.sum(0)], "_gram": [(a.T @ a).ravel()]})

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total = int(pdf["_n"].sum()), np.sum(pdf["_sum"].tolist(), axis=0)
        gram = np.sum(pdf["_gram"].tolist(), axis=0).reshape(len(total), -1) - np.outer(total, total) / n
        return pd.DataFrame([(pdf[group].iloc[0], rank_of_spread(gram), n)], columns=[group, "effective_rank", "rows"])

    added = df.select(group, vector).mapInPandas(sums, f"{group} {kind}, _n long, _sum array<double>, _gram array<double>")
    return added.groupBy(group).applyInPandas(rank, f"{group} {kind}, effective_rank double, rows long")


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small axes, such as prompts, recipes and seeds; all but the first are broadcast, so they must be short."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out


def judged_votes(votes: DataFrame, public: DataFrame, private: DataFrame, pair: str) -> DataFrame:
    """votes with their public pair and its private mapping; a vote without either is an error."""
    held = votes.join(public.withColumn("_pub", F.lit(1)), pair, "left").join(private.withColumn("_priv", F.lit(1)), pair, "left")
    whole = F.assert_true(F.col("_pub").isNotNull() & F.col("_priv").isNotNull(), F.lit("a vote has no pair")).isNull()
    return held.filter(whole).drop("_pub", "_priv")
