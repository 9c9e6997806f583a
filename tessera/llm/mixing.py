"""Mixing sources to target weights by systematic sampling (operator 7).

Every source gets a target in words; targets above `max_repeat` times what the source has are cut
there, and the excess is shared again by weight among the others. A source's rate (target over
size) is the expected number of copies of each of its documents. The documents of a source are
laid out in a fixed order; their expected copies are prefix-summed, one random offset per source is
added, and a document is emitted once for each integer boundary that its stretch crosses.

The order goes by size class first, so the copies are spread evenly over short and long documents
and the words taken come near the target, not just the number of documents. Within a class it goes
by a seeded hash. No offset makes up for a document that is itself a good part of its source's target, so such
documents (more than one part in `CERTAIN` of the target) get whole expected copies: from the longest on, the rate rounded so that
the words owed so far are met, what is left over passing on to the next. The other documents share the words that remain at one rate.

Rates and offsets are multiples of 2^-20, so prefix sums are exact. They need no task that holds a whole source: rows are
counted by (source, class, hash slice), those counts are summed up, and rows are ranked within their own slice only.
The number of slices follows the number of rows, so a source with a third of all rows is cut into
as many more pieces.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order;
sources without a word have target 0 and are not taken; identical rows are interchangeable; an empty
table gives an empty result; other columns pass through, and input columns named like the result's
(`size`, `source_size`, `target`, `copies`, `taken`) are replaced (`mixed_rows` returns them untouched). A rerun gives the same copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm._common import cut, own, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 7_331
ROWS_PER_SLICE = 8_000
MAX_SLICES = 4096
CLASSES_PER_DOUBLING = 8
#: A document of more than one part in so many of its source's target has whole expected copies; at most CERTAIN / rate in a source.
CERTAIN = 100
#: The class of those documents.
LONG = 1_000
UNIT = float(1 << 20)
#: The plan per source is made on the driver; there it is a few dozen bytes a source.
MAX_SOURCES = 1_000_000
#: Plans up to this many sources (a few MB) are broadcast to the documents.
BROADCAST_SOURCES = 50_000
OWN = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float, share: float = 1.0) -> list[float]:
    """Words wanted of each source: by weight, at most max_repeat times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i in range(len(sizes))]
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > max_repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def crossings(start: Column, rate: Column, offset: Column) -> Column:
    """Integer boundaries crossed by a document of `rate` expected copies after `start` such documents."""
    return F.floor((start + 1) * rate + offset) - F.floor(start * rate + offset)


def whole_copies(sizes: Sequence[int], rate: float) -> list[int]:
    """Copies of long documents, from the longest on: the rate, rounded so that the words owed so far are met."""
    out, owed = [], 0.0
    for size in sizes:
        owed += rate * size
        copies = min(math.ceil(rate), max(math.floor(rate), math.floor(owed / size + 0.5)))
        owed -= copies * size
        out.append(copies)
    return out


def _long_documents(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source: the copies of its long documents in their order, and the rate of the others."""
    rows = rows.sort_values(["size", "card", "tie"], ascending=[False, True, True])
    source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    sizes = rows["size"].tolist()
    copies = whole_copies(sizes, target / source_size)
    rest = source_size - sum(sizes)
    rate = max(0.0, (target - sum(c * s for c, s in zip(copies, sizes, strict=True))) / rest) if rest else 0.0
    return pd.DataFrame({"source": [rows["source"].iloc[0]], "long_copies": [copies], "rest_rate": [min(rate, float(rows["most"].iloc[0]))]})


def _mixed(docs: DataFrame, weights: Sequence[float], max_repeat: int, key: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(row, size, source_size, target, copies): every row of docs as a struct."""
    spark = docs.sparkSession
    col = lambda c: F.col(f"`{c}`")
    measures = [col(source_col).cast("string").alias("source"), n_words(col(text_col)).alias("size"), F.xxhash64(F.lit(seed), col(key)).alias("card"), F.xxhash64(col(text_col)).alias("tie")]
    narrow = cut(docs.select(*measures))
    slices = max(1, min(MAX_SLICES, math.ceil(narrow.count() / ROWS_PER_SLICE)))
    held = narrow.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    held.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in held], [weights[i % len(weights)] for i in range(len(held))], max_repeat)
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    plan = spark.createDataFrame([(r["source"], r["words"], t) for r, t in zip(held, wanted, strict=True)], kind)
    small = F.broadcast if len(held) <= BROADCAST_SOURCES else (lambda df: df)

    def graded(rows: DataFrame, by: DataFrame) -> DataFrame:
        joined = rows.alias("d").join(small(by).alias("p"), F.expr("d.source <=> p.source")).select("d.*", *[f"p.{c}" for c in by.columns if c != "source"])
        long = F.col("size") * CERTAIN > F.col("target")
        grade = F.when(F.col("target") <= 0, -1).when(long, LONG).otherwise(F.floor(CLASSES_PER_DOUBLING * F.log2(F.col("size") + 1)))
        return joined.withColumns({"grade": grade.cast("int"), "slice": F.when(long & (F.col("target") > 0), 0).otherwise(F.pmod("card", F.lit(slices))).cast("int")})

    laid = graded(narrow, plan)
    whole = "source string, long_copies array<int>, rest_rate double"
    longs = laid.filter(F.col("grade") == LONG).withColumn("most", F.lit(float(max_repeat))).groupBy("source").applyInPandas(_long_documents, whole)
    rate = F.coalesce("rest_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.alias("p").join(longs.alias("l"), F.expr("p.source <=> l.source"), "left").select("p.*", "long_copies", (F.floor(rate * UNIT) / UNIT).alias("rate"))
    plan = cut(plan.withColumn("offset", F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(1 << 20)) / UNIT))

    counted = laid.groupBy("source", "grade", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("grade", "slice").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(counted.select("source", "grade", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))

    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *measures)
    by = W.partitionBy("source", "grade", "slice").orderBy(F.desc("size"), "card", "tie")
    ranked = graded(packed, plan).withColumn("rank", F.row_number().over(by) - 1)
    both = ranked.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.grade = s.grade and d.slice = s.slice")).select("d.*", "before")
    copies = F.when(F.col("grade") == LONG, F.get("long_copies", F.col("rank"))).otherwise(crossings(F.col("before") + F.col("rank"), F.col("rate"), F.col("offset")))
    return both.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    key: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """All rows of docs with size, source_size, target (of the source), copies and taken (words)."""
    mixed = _mixed(docs, weights, max_repeat, key, text_col, source_col, seed)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in OWN]
    return mixed.select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix_sources as often as its copies say, without the result's own columns."""
    (copy,) = own(mixed, "_copy")
    return _repeated(mixed, copy).drop(copy, *OWN)


def _repeated(mixed: DataFrame, copy: str) -> DataFrame:
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mix takes it, all its columns whatever their names."""
    mixed = _mixed(docs, WEIGHTS, MAX_REPEAT, "doc_id", "text", "source", SEED)
    return _repeated(mixed, "copy").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
