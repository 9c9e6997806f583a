"""Composition and concentration of a corpus: counts, shares, caps, grains, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def counts_by(df: DataFrame, field: str) -> DataFrame:
    """(value, n) by count, then value; blanks as (missing)."""
    value = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("(missing)"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def top_share(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """The n largest counts with their share of all rows."""
    held = df.groupBy(field).agg(F.count("*").alias("n"))
    total = held.agg(F.sum("n").alias("_total"))
    return held.orderBy(F.desc("n"), field).limit(n).crossJoin(F.broadcast(total)).select(field, "n", (F.col("n") / F.col("_total")).alias("share"))


def sums_and_shares(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts, sums and each sum's share of the total."""
    held = df.groupBy(*by).agg(F.count("*").alias("documents"), *[F.sum(v).alias(v) for v in values])
    every = held.agg(*[F.sum(v).alias(f"_{v}") for v in values])
    held = held.crossJoin(F.broadcast(every))
    return held.select(*by, "documents", *values, *[(F.col(v) / F.nullif(F.col(f"_{v}"), F.lit(0))).alias(f"{v}_share") for v in values])


def cap_violations(df: DataFrame, caps: dict[str, float], value: str) -> DataFrame:
    """(grain, name, share) of groups whose share of the value is strictly above their grain's cap."""
    out = None
    for grain, cap in caps.items():
        held = sums_and_shares(df, [grain], [value]).filter(F.col(f"{value}_share") > cap)
        held = held.select(F.lit(grain).alias("grain"), F.col(grain).cast("string").alias("name"), F.col(f"{value}_share").alias("share"))
        out = held if out is None else out.unionAll(held)
    return out


def grains(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Several groupings in one pass; columns outside a grouping are null, `grain` names the grouping."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    held = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.grouping_id().alias("_id"), *aggregates)
    names = {sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s): "+".join(s) or "all" for s in sets}
    name = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return held.withColumn("grain", name[F.col("_id").cast("int")]).drop("_id")


def ceiling(df: DataFrame, group: str, value: str, most: float) -> DataFrame:
    """One row: the largest group and share, whether it needs reweighting and whether a ceiling is feasible at all."""
    held = df.groupBy(group).agg(F.sum(value).alias("_v"))
    row = held.agg(F.max_by(group, "_v").alias("largest"), (F.max("_v") / F.sum("_v")).alias("share"), F.count("*").alias("groups"))
    return row.withColumn("reweight", F.col("share") > most).withColumn("feasible", F.col("groups") * most >= 1)


def decisions(df: DataFrame, by: Sequence[str], characters: str, decision: str) -> DataFrame:
    """Rows and characters, all, retained and for training."""
    kept = ~F.startswith(F.col(decision), F.lit("exclude_"))
    train = F.startswith(F.col(decision), F.lit("train"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(characters))), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(characters).alias("characters"), total(kept).alias("retained_characters"), total(train).alias("training_characters"))


def shared_across(df: DataFrame, version: str, key: str) -> DataFrame:
    """(left, right, shared): ids that each two versions share."""
    held = df.select(version, key).distinct()
    pairs = held.select(F.col(version).alias("left"), key).join(held.select(F.col(version).alias("right"), key), key).filter("left < right")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared"))


def split_labels(df: DataFrame, cell: str, weight: str, n: int, separator: str = " | ") -> DataFrame:
    """The n labels with most weight, after splitting cells, with their share of the unsplit total."""
    total = df.agg(F.sum(weight).alias("_total"))
    held = df.select(F.explode(F.split(F.col(cell), "\\Q" + separator + "\\E")).alias("label"), weight).groupBy("label").agg(F.sum(weight).alias("weight"))
    return held.orderBy(F.desc("weight"), "label").limit(n).crossJoin(F.broadcast(total)).select("label", "weight", (F.col("weight") / F.col("_total")).alias("share"))


def alias_ledger(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, representative): labels without a comma first, then short, then by lower case."""
    held = df.groupBy(group, label).agg(F.count("*").alias("n"))
    best = F.struct(F.contains(label, F.lit(",")), F.length(label), F.lower(label), F.col(label))
    return held.withColumn("representative", F.min_by(F.col(label), best).over(W.partitionBy(group)))


def distinct_or_conflict(df: DataFrame, key: str) -> DataFrame:
    """Keys that come with different rows, and how many."""
    return df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*df.columns))).alias("variants")).filter("variants > 1")


def digest(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row: SHA-256 over (id, zero byte, hash, line feed) in id order; for sets that fit a task."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["k"], F.lit("\0"), r["v"], F.lit("\n"))), "")
    return df.agg(F.sha2(text, 256).alias("digest"))


def stage_plan(totals: DataFrame, role: str, tokens: str, primary: str, shares: dict[str, float], align: int) -> DataFrame:
    """(role, budget): the primary role's tokens over its share, dealt out by share, floored to the alignment."""
    base = totals.filter(F.col(role) == primary).agg(F.sum(tokens).alias("_p"))
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, float(v))])
    held = totals.select(role).distinct().filter(F.col(role).isin(*shares)).crossJoin(F.broadcast(base))
    whole = F.col("_p") / shares[primary]
    return held.select(role, (F.floor(whole * share[F.col(role)] / align) * align).cast("long").alias("budget"))


def concentration(drawn: DataFrame, group: str, tokens: str) -> DataFrame:
    """One row: the group that the drawn windows show most, and its share."""
    return ceiling(drawn, group, tokens, 1.0).select("largest", "share")


def estimated(df: DataFrame, measured: str, stratum: str) -> DataFrame:
    """df with `estimate`: what was measured, else the stratum's mean, else the median of all."""
    median = df.agg(F.percentile(measured, F.lit(0.5)).alias("_median"))
    mean = F.avg(measured).over(W.partitionBy(stratum))
    return df.crossJoin(F.broadcast(median)).withColumn("estimate", F.coalesce(F.col(measured).cast("double"), mean, "_median")).drop("_median")


def stage_completeness(df: DataFrame, stage: str, update: str, loss: str, elapsed: str) -> DataFrame:
    """Last update, mean loss and elapsed time of each stage of a telemetry table."""
    return df.groupBy(stage).agg(F.max(update).alias("updates"), F.avg(loss).alias("mean_loss"), F.max_by(elapsed, update).alias("elapsed"))
