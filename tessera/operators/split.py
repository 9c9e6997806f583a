"""Deterministic splits and samples: by salted hashes, by group, by stratum, by allocation."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T


def hash_order(salt: str, key: Column, glue: str = ":") -> Column:
    """SHA-256 hex of salt, glue and key: a fixed pseudo-random order."""
    return T.sha(F.concat(F.lit(salt + glue), key.cast("string")))


def percent_split(seed: str, key: Column) -> Column:
    """train, validation or test at 80, 10 and 10 of a hundred, by the first 8 hex digits."""
    at = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(at < 80, "train").when(at < 90, "validation").otherwise("test")


def below_fraction(salt: str, key: Column, fraction: float) -> Column:
    """Whether the first 64 bits lie below the fraction; compared as hex text, so nothing overflows."""
    limit = int(fraction * (1 << 64))
    if limit >= 1 << 64:
        return F.lit(True)
    return F.substring(hash_order(salt, key), 1, 16) < F.lit(f"{limit:016x}")


def top_per_stratum(df: DataFrame, stratum: str, key: str, n: int, salt: str) -> DataFrame:
    """The first n rows of each stratum in hash order."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(salt, F.col(key)), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, salt: str) -> DataFrame:
    """n rows, one of each stratum in turn, in hash order within it; `position` counts from 1."""
    few = top_per_stratum(df, stratum, key, n, salt)  # no stratum can give more than n
    turn = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(salt, F.col(key)), key))
    taken = few.withColumn("_turn", turn).orderBy("_turn", stratum).limit(n)
    return taken.withColumn("position", F.row_number().over(W.orderBy("_turn", stratum))).drop("_turn")


def first_middle_last(df: DataFrame, group: str, order: str) -> DataFrame:
    """The first, middle and last row of each group."""
    by = W.partitionBy(group)
    held = df.withColumn("_at", F.row_number().over(by.orderBy(order))).withColumn("_n", F.count("*").over(by))
    return held.filter((F.col("_at") == 1) | (F.col("_at") == F.expr("_n div 2 + 1")) | (F.col("_at") == F.col("_n"))).drop("_at", "_n")


def tail_holdout(text: Column, fraction: float) -> Column:
    """(train, validation): the text's last part, cut at the first line feed behind the target, or else the last before it."""
    body = T.strip(text)
    target = F.greatest(F.lit(1), F.floor(F.length(body) * (1 - fraction)).cast("int"))
    after = F.call_function("locate", F.lit("\n"), body, target + 1)
    before = target - F.call_function("locate", F.lit("\n"), F.reverse(F.left(body, target)), F.lit(1)) + 1
    at = F.when(after > 0, after).otherwise(F.when(F.contains(F.left(body, target), F.lit("\n")), before).otherwise(F.lit(0)))
    train = F.regexp_replace(F.left(body, at - 1), r"(?U)\s+$", "")
    rest = F.regexp_replace(F.substring(body, at, F.length(body)), r"(?U)^\s+", "")
    return F.when(at > 0, F.struct(train.alias("train"), rest.alias("validation")))


def tail_tokens(tokens: Column, fraction: float) -> Column:
    """(train, validation) of a token array, at least one token on each side."""
    n = F.size(tokens)
    held = F.least(F.greatest(F.lit(1), F.floor(n * fraction).cast("int")), n - 1)
    return F.when(n >= 2, F.struct(F.slice(tokens, F.lit(1), n - held).alias("train"), F.slice(tokens, n - held + 1, held).alias("validation")))


def largest_remainder(df: DataFrame, key: str, available: str, total: int, minimum: int) -> DataFrame:
    """df with `allocated`: a minimum for each, the rest in proportion to what is left, remainders to the largest fractions, then ids."""
    every = W.partitionBy()
    least = F.least(F.lit(minimum).cast("bigint"), F.col(available))
    held = df.withColumn("_least", least).withColumn("_room", F.col(available) - F.col("_least"))
    sums = df.select(F.sum(least).alias("_used"), F.sum(F.col(available) - least).alias("_rooms"), F.count("*").alias("_count"))
    held = held.crossJoin(F.broadcast(sums)).withColumn("_left", total - F.col("_used"))
    ok = (F.col("_left") >= 0) & (F.col("_left") <= F.col("_rooms")) & (F.col("_count") <= total)
    held = held.filter(F.assert_true(ok, F.lit("the total doesn't lie between the minimums and what is available")).isNull())
    held = held.withColumn("_exact", F.when(F.col("_rooms") > 0, F.col("_left") * F.col("_room") / F.col("_rooms")).otherwise(0.0))
    held = held.withColumn("_whole", F.floor("_exact"))
    rank = F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_whole")), key))
    spare = F.col("_left") - F.sum("_whole").over(every)
    held = held.withColumn("_rank", rank).withColumn("_spare", spare)
    allocated = F.col("_least") + F.col("_whole") + F.when(F.col("_rank") <= F.col("_spare"), 1).otherwise(0)
    return held.withColumn("allocated", allocated.cast("bigint")).drop("_least", "_room", "_used", "_rooms", "_count", "_left", "_exact", "_whole", "_rank", "_spare")


def in_order_allocation(df: DataFrame, key: str, available: str, total: int, minimum: int) -> DataFrame:
    """df with `allocated`: a minimum for each, floors of the shares, and what remains filled up in the order of the ids."""
    least = F.least(F.lit(minimum).cast("bigint"), F.col(available))
    sums = df.select(F.sum(least).alias("_used"), F.sum(F.col(available) - least).alias("_rooms"))
    held = df.crossJoin(F.broadcast(sums)).withColumn("_least", least).withColumn("_left", F.greatest(F.lit(0), total - F.col("_used")))
    share = F.when(F.col("_rooms") > 0, F.floor(F.col("_left") * (F.col(available) - F.col("_least")) / F.col("_rooms"))).otherwise(0)
    held = held.withColumn("_whole", F.col("_least") + F.least(share, F.col(available) - F.col("_least")))
    held = held.withColumn("_room", F.col(available) - F.col("_whole")).withColumn("_rest", F.greatest(F.lit(0), total - F.sum("_whole").over(W.partitionBy())))
    before = F.coalesce(F.sum("_room").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_rest") - before))
    return held.withColumn("allocated", (F.col("_whole") + extra).cast("bigint")).drop("_used", "_rooms", "_least", "_left", "_whole", "_room", "_rest")


def even_spans(text: Column, count: Column, per_chunk: int = 2_000, most: int = 16) -> Column:
    """(start, size) of evenly spaced chunks that add up to `count` characters; the whole text if it has no more."""
    n = F.length(text)
    chunks = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(count / per_chunk))).cast("int")
    size = lambda i: (F.floor(count / chunks) + F.when(i < count % chunks, 1).otherwise(0)).cast("int")
    start = lambda i: F.when(chunks == 1, F.floor((n - size(i)) / 2)).otherwise(F.floor((n - size(i)) * i / F.greatest(F.lit(1), chunks - 1))).cast("int")
    spread = F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.struct(start(i).alias("start"), size(i).alias("size")))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("size")))
    none = F.array().cast("array<struct<start:int,size:int>>")
    return F.when(count <= 0, none).when(count >= n, whole).otherwise(spread)


def sample_evenly(text: Column, count: Column) -> Column:
    """The text of the even spans, joined by line feeds."""
    return F.array_join(F.transform(even_spans(text, count), lambda s: F.substring(text, s["start"] + 1, s["size"])), "\n")


def even_indices(k: int, n: int) -> list[int]:
    """k evenly spaced indices of n, rounded half to even; k = 1 gives 0; duplicates are an error."""
    held = [0] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]
    if len(set(held)) != k or not 0 < k <= n:
        raise ValueError("the indices aren't distinct")
    return held


def grouped_split(df: DataFrame, group: str, seed: str, fraction: float) -> DataFrame:
    """df with `split`: the groups first in hash order, a rounded fraction but one at least, go to validation."""
    groups = df.select(group).distinct()
    n = groups.count()
    most = max(1, round(n * fraction))
    held = groups.orderBy(hash_order(seed, F.col(group), "|"), group).limit(most).select(F.col(group).alias("_g"))
    return df.join(held, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("split", F.when(F.col("_g").isNotNull(), "validation").otherwise("train")).drop("_g")


def disjoint_holdout(components: DataFrame, key: str, size: str, stratum: str, fractions: Mapping[str, float], seed: str, forced: str | None = None) -> DataFrame:
    """(key, split): whole components to splits so that each stratum nears its fraction, greedily in hash order, large misses first.

    components: one row for each component (a summary, small); `forced` names a boolean that keeps a component in train."""
    rows = components.select(key, F.col(size).cast("double").alias("_n"), stratum, (F.col(forced) if forced else F.lit(False)).alias("_f"), hash_order(seed, F.col(key)).alias("_h")).collect()
    spark, total = components.sparkSession, {}
    for r in rows:
        total[r[2]] = total.get(r[2], 0.0) + r[1]
    want = {(s, split): f * total[s] for s in total for split, f in fractions.items()}
    out = []
    for r in sorted(rows, key=lambda r: (r["_h"], str(r[0]))):
        left = {split: want[r[2], split] for split in fractions}
        split = max(left, key=lambda s: (left[s], s)) if left and not r["_f"] else None
        if split is not None and left[split] >= r[1]:
            want[r[2], split] -= r[1]
            out.append((r[0], split))
        else:
            out.append((r[0], "train"))
    return spark.createDataFrame(out, f"{key} {dict(components.dtypes)[key]}, split string")


def holdout_misses(counts: np.ndarray, target: float, totals: np.ndarray, weight: float) -> np.ndarray:
    """How far each row of counts (one column for each stratum) is from a held-out target.

    The squared relative miss of the whole, and `weight` times the strata's own, each by its share of all."""
    share = totals / totals.sum()
    want = target * share
    whole = ((counts.sum(-1) - target) / max(target, 1)) ** 2
    return whole + weight * ((((counts - want) / np.maximum(want, 1)) ** 2) * share).sum(-1)


def nearest_holdout(components: DataFrame, key: str, stratum: str, size: str, target: int, seed: str, split: str = "validation", weight: float = 1.0, most: int | None = None) -> DataFrame:
    """(key, position): whole components for a held-out split, one after another the one that brings its counts nearest the target.

    components: (key, stratum, size), a summary with one row for each component and stratum, small. Ties go by hash, components
    over `most` rows stay out, and the choice ends when no component brings the counts nearer."""
    rows = components.groupBy(key, stratum).agg(F.sum(size).alias("_n")).collect()
    names, strata = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    place, column = {k: i for i, k in enumerate(names)}, {s: i for i, s in enumerate(strata)}
    held = np.zeros((len(names), len(strata)))
    for r in rows:
        held[place[r[0]], column[r[1]]] += r["_n"]
    order = sorted(range(len(names)), key=lambda i: hashlib.sha256(f"{seed}:{split}:{names[i]}".encode()).hexdigest())
    names, held = [names[i] for i in order], held[order]  # ties: the first of the least misses
    totals, sofar, out = held.sum(0), np.zeros(len(strata)), []
    free = np.ones(len(names), bool) if most is None else held.sum(1) <= most
    miss = holdout_misses(sofar, target, totals, weight) if len(names) else 0.0
    while free.any():
        misses = np.where(free, holdout_misses(held + sofar, target, totals, weight), np.inf)
        best = int(misses.argmin())
        if misses[best] >= miss - 1e-15:
            break
        miss, free[best] = misses[best], False
        sofar = sofar + held[best]
        out.append((names[best], len(out) + 1))
    return components.sparkSession.createDataFrame(out, f"{key} {dict(components.dtypes)[key]}, position int")


def balanced_selection(df: DataFrame, key: str, author: str, work: str, n: int, seed: str) -> DataFrame:
    """n rows, always the one of the least used work, then author, then hash: a fold over one group."""
    held = df.select(key, author, work, hash_order(seed, F.col(key), "|").alias("_h"))

    def fold(pdf):
        import heapq

        import pandas as pd

        authors: dict = {}
        works: dict = {}
        heap = [(0, 0, h, str(k), i) for i, (k, h) in enumerate(zip(pdf[key], pdf["_h"], strict=True))]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < n:
            w, a, h, k, i = heapq.heappop(heap)
            now = (works.get(pdf[work].iloc[i], 0), authors.get(pdf[author].iloc[i], 0))
            if (w, a) != now:  # counts only grow: put back at its present place
                heapq.heappush(heap, (*now, h, k, i))
                continue
            works[pdf[work].iloc[i]] = now[0] + 1
            authors[pdf[author].iloc[i]] = now[1] + 1
            out.append((pdf[key].iloc[i], len(out) + 1))
        return pd.DataFrame(out, columns=["_k", "position"])

    chosen = held.groupBy().applyInPandas(fold, f"_k {dict(df.dtypes)[key]}, position int")
    return df.join(chosen, F.col(key) == F.col("_k")).drop("_k")


def blind_sample(ids: Sequence, n: int, seed: int, salt: str) -> list[tuple]:
    """n of the sorted ids by Python's seeded generator, each with a blind id."""
    chosen = random.Random(seed).sample(sorted(ids), n)
    return [(k, hashlib.sha256(f"{salt}|{k}".encode()).hexdigest()[:16]) for k in chosen]


def landmarks(n: Column) -> Column:
    """Positions at the first, quarter, half, three quarters and last of n."""
    return F.array_distinct(F.array(F.lit(0), *[F.floor((n - 1) * k / 4).cast("int") for k in (1, 2, 3)], (n - 1).cast("int")))


def interleave(df: DataFrame, component: str, order: str) -> DataFrame:
    """df with `place`: the components evenly interleaved, each row at (i + 0.5) / its component's rows."""
    by = W.partitionBy(component)
    at = (F.row_number().over(by.orderBy(order)) - 0.5) / F.count("*").over(by)
    return df.withColumn("place", at).orderBy("place", component)


def replay_sample(df: DataFrame, order: str, text: str, chunks: int, chunk_chars: int) -> DataFrame:
    """Lines of evenly spaced windows over a corpus laid end to end: rows whose start lies in one of the windows.

    df holds one line to a row; the line that a window begins inside is left to the one before."""
    size = F.length(text) + 1
    total = df.agg(F.sum(size)).first()[0] or 0
    start = F.coalesce(F.sum(size).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stride = max(1, (total - chunk_chars) // max(1, chunks - 1))
    placed = df.withColumn("_start", start).withColumn("window", F.least(F.floor(F.col("_start") / stride), F.lit(chunks - 1)))
    return placed.filter(F.col("_start") - F.col("window") * stride < chunk_chars).drop("_start")


def probe_cycles(df: DataFrame, key: str, n: str, count: int, minimum: int, span: int, seed: str) -> DataFrame:
    """(key, offset, cycle): one excerpt of each document in turn, documents and their offsets in hash order, until `count`.

    A sampling operator: too few excerpts are an error."""
    starts = F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - minimum, F.lit(span).cast("long"))
    each = df.filter(F.col(n) >= minimum).select(key, F.explode(starts).alias("offset"))
    salted = hash_order(seed, F.concat(F.col(key).cast("string"), F.lit(":"), F.col("offset").cast("string")))
    cycle = F.row_number().over(W.partitionBy(key).orderBy(salted, "offset")) - 1
    held = each.withColumn("cycle", cycle).orderBy("cycle", hash_order(seed, F.col(key)), key).limit(count)
    enough = held.agg(F.count("*").alias("_n"))
    return held.crossJoin(F.broadcast(enough)).filter(F.assert_true(F.col("_n") == count, F.lit("too few excerpts")).isNull()).drop("_n")
