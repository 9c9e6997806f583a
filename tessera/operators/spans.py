"""Half-open character spans: merging, complements, removal, line blocks, localisation of a reference in a text."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T


def merge(df: DataFrame, key: str, touching: bool = True) -> DataFrame:
    """(key, start, stop): overlapping spans as one; spans that only touch too, if `touching`."""
    before = W.partitionBy(key).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    opens = F.when(reach.isNull() | (F.col("start") > reach if touching else F.col("start") >= reach), 1).otherwise(0)
    marked = df.select(key, "start", "stop", opens.alias("_opens"))
    island = F.sum("_opens").over(W.partitionBy(key).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def complement(df: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, kept): spans that cover [0, length) without gaps; df holds merged spans to remove."""
    ends = lengths.select(key, F.col("length").alias("start"), F.col("length").alias("stop"))
    both = df.select(key, "start", "stop").unionByName(ends)
    last = F.coalesce(F.lag("stop").over(W.partitionBy(key).orderBy("start", "stop")), F.lit(0))
    gaps = both.withColumn("_last", last).select(key, F.col("_last").alias("start"), F.col("start").alias("stop"), F.lit(True).alias("kept"))
    return gaps.unionByName(df.select(key, "start", "stop", F.lit(False).alias("kept"))).filter("stop > start")


def remove(texts: DataFrame, spans: DataFrame, key: str, text: str, glue: str = "") -> DataFrame:
    """(key, text): the texts without the merged spans; what remains is joined by `glue`."""
    kept = complement(spans, texts.select(key, F.length(text).alias("length")), key).filter("kept")
    parts = kept.join(texts.select(key, text), key).select(key, "start", F.substring(F.col(text), F.col("start") + 1, F.col("stop") - F.col("start")).alias("_p"))
    held = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "_p"))).alias("_all"))
    joined = held.select(key, F.array_join(F.transform("_all", lambda x: x["_p"]), glue).alias("_t"))
    return texts.select(key).join(joined, key, "left").select(key, F.coalesce("_t", F.lit("")).alias(text))


def line_blocks(text: Column) -> Column:
    """Blocks of filled lines between blank lines, with the lines of each: an array of arrays."""
    blocks = F.split(F.concat(F.lit("\n"), text), r"(?U)\n[^\S\n]*(?=\n)", -1)
    return F.filter(F.transform(blocks, T.filled_lines), lambda b: F.size(b) > 0)


def block_patterns(df: DataFrame, key: str, sizes: tuple[int, ...] = (4, 4, 3, 3)) -> DataFrame:
    """(key, first): where a run of blocks has the given line counts, taken greedily from the front, without overlap.

    df holds (key, position, n) for each block."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        n, out, at = pdf.sort_values("position")["n"].tolist(), [], 0
        while at + len(sizes) <= len(n):
            if tuple(n[at : at + len(sizes)]) == sizes:
                out.append((pdf[key].iloc[0], at))
                at += len(sizes)
            else:
                at += 1
        return pd.DataFrame(out, columns=[key, "first"])

    return df.select(key, "position", "n").groupBy(key).applyInPandas(scan, f"{key} {dict(df.dtypes)[key]}, first int")


def coverage_violations(df: DataFrame, key: str, length: str) -> DataFrame:
    """Segments (key, start, stop) that don't start where the one before ends, or whose last doesn't end at the length."""
    by = W.partitionBy(key).orderBy("start", "stop")
    held = df.withColumn("_before", F.coalesce(F.lag("stop").over(by), F.lit(0))).withColumn("_next", F.lead("start").over(by))
    return held.filter((F.col("start") != F.col("_before")) | (F.col("_next").isNull() & (F.col("stop") != F.col(length)))).drop("_before", "_next")


def line_context(df: DataFrame, key: str, position: str, line: str, before: int = 3, after: int = 3) -> DataFrame:
    """df with the lines around each line."""
    around = W.partitionBy(key).orderBy(position).rowsBetween(-before, after)
    return df.withColumn("context", F.collect_list(line).over(around))


def carry_forward(df: DataFrame, key: str, position: str, heading: str) -> DataFrame:
    """df with the last heading at or before each row."""
    so_far = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(heading, ignorenulls=True).over(so_far))


def increasing_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that rises in both places (patience)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def localize(pairs: DataFrame, key: str, text: str, reference: str, n: int = 8, gap: int = 40, least: float = 0.8) -> DataFrame:
    """pairs with `ranges` (start, stop), `coverage` and `method`: where the reference stands in the text.

    Shared word n-grams anchor the reference; runs of anchors that lie close are one range. Every full copy gives a
    range; otherwise the longest rising chain of anchors may give several."""
    from tessera.functions.udfs import positioned

    def find(t: str, r: str) -> dict:
        words, ref = positioned(t), [w["word"] for w in positioned(r)]
        size = min(n, len(ref))
        if not size:
            return {"ranges": [], "coverage": 0.0, "method": "none"}
        where: dict = {}
        for j in range(len(ref) - size + 1):
            where.setdefault(tuple(ref[j : j + size]), []).append(j)
        flat = [w["word"] for w in words]
        hits = [(i, j) for i in range(len(flat) - size + 1) for j in where.get(tuple(flat[i : i + size]), ())]
        groups: list[list[tuple[int, int]]] = []
        for i, j in sorted(hits):
            if groups and i - groups[-1][-1][0] <= gap and j >= groups[-1][-1][1]:
                groups[-1].append((i, j))
            else:
                groups.append([(i, j)])
        share = lambda g: len({k for _, j in g for k in range(j, j + size)}) / len(ref)
        span = lambda g: {"start": words[g[0][0]]["start"], "stop": words[g[-1][0] + size - 1]["stop"]}
        full = [g for g in groups if share(g) >= least]
        if full:
            return {"ranges": [span(g) for g in full], "coverage": max(map(share, full)), "method": "shingle_alignment"}
        chain = increasing_chain(hits)
        if share(chain) >= least:
            parts: list[list[tuple[int, int]]] = []
            for i, j in chain:
                if parts and i - parts[-1][-1][0] <= gap:
                    parts[-1].append((i, j))
                else:
                    parts.append([(i, j)])
            return {"ranges": [span(g) for g in parts], "coverage": share(chain), "method": "fragmented_alignment"}
        return {"ranges": [], "coverage": share(chain), "method": "none"}

    schema = "struct<ranges:array<struct<start:int,stop:int>>,coverage:double,method:string>"

    @F.pandas_udf(schema)
    def run(t: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(a or "", b or "") for a, b in zip(t, r, strict=True)], columns=["ranges", "coverage", "method"])

    return pairs.withColumn("located", run(F.col(text), F.col(reference)))
