"""Sharding by a two-pass external shuffle (operator 4), with DataFrame functions only.

Pass 1 scatters the records by a seeded hash over buckets that fit in memory: the one exchange of
the records. Pass 2 puts each bucket into a defined order, shuffles it as an array with Spark's
seeded Fisher-Yates expression and lays the buckets end to end. That global order is cut into
shards whose row counts differ by one at most (law `rows`).

How many buckets there are follows from the bytes of the table. A count per small group of hash
values gives that and the buckets' offsets, so only (bucket, count) rows are ever summed up, in two
levels. A bucket's order before the shuffle depends on the rows alone, and the exchange has a fixed
number of partitions, so a task that runs again deals the same cards.

Defined cases: a null text has no bytes and counts as one byte with its separator; rows with a null
or repeated key are scattered by key and text together; identical rows fall into one bucket and are
interchangeable; an empty table gives an empty result; other columns pass through, and input columns
named like the result's (`shard`, `slot`, `position`) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._common import cut, table

BUCKET_BYTES = 16 << 20
ROWS_PER_GROUP = 256
MAX_PARTITIONS = 100_000
SEED = 20_240


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one for its separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def offsets(counts: DataFrame, key: str, n: str, width: int = 4096) -> DataFrame:
    """counts with `offset`: the sum of n over smaller keys, by way of sums over blocks of so many keys."""
    block = F.floor(F.col(key) / width)
    blocks = counts.groupBy(block.alias("_block")).agg(F.sum(n).alias("_sum"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_block", block).withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return placed.join(blocks, "_block").select(key, n, (F.col("_start") + F.col("_inside")).alias("offset"))


def external_shuffle(
    docs: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows of docs with `position` (in the whole order), `shard` and `slot` (in the shard)."""
    kept = [c for c in docs.columns if c not in ("position", "shard", "slot")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    total = docs.count()
    if not total:
        return docs.withColumns({"position": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_groups = max(1, math.ceil(total / ROWS_PER_GROUP))
    texts = F.xxhash64(F.col(text_col))
    card = F.xxhash64(F.lit(seed), F.col(key), texts)
    group = F.pmod(card, F.lit(n_groups))

    sums = cut(docs.groupBy(group.alias("_group")).agg(F.count("*").alias("n"), F.sum(n_bytes(F.col(text_col))).alias("bytes")))
    size = sums.agg(F.sum("bytes")).first()[0]
    wide = max(1, math.ceil(n_groups / math.ceil(size / bucket_bytes)))  # groups to a bucket
    n_buckets = math.ceil(n_groups / wide)
    parts = min(MAX_PARTITIONS, n_buckets)

    bucket_of = lambda g: F.floor(g / wide).cast("long")
    starts = offsets(sums.groupBy(bucket_of(F.col("_group")).alias("_bucket")).agg(F.sum("n").alias("n")), "_bucket", "n")
    starts = starts.repartition(parts, "_bucket")

    record = F.struct(*[F.col(f"`{c}`") for c in kept])
    scattered = docs.select(bucket_of(group).alias("_bucket"), card.alias("_a"), F.col(key).alias("_b"), record.alias("_r"))
    held = scattered.repartition(parts, "_bucket").groupBy("_bucket").agg(F.collect_list(F.struct("_a", "_b", "_r")).alias("_all"))
    held = held.sortWithinPartitions("_bucket")  # the generator of a partition deals its buckets in this order, rerun or not
    by_card = lambda x, y: F.when(x["_a"] < y["_a"], -1).when(x["_a"] > y["_a"], 1).when(x["_b"] < y["_b"], -1).when(x["_b"] > y["_b"], 1).otherwise(0)
    dealt = held.select("_bucket", F.shuffle(F.array_sort("_all", by_card), seed).alias("_all")).join(starts, "_bucket")
    dealt = dealt.select("offset", F.posexplode("_all").alias("_at", "_x"))
    position = F.col("offset") + F.col("_at")
    return (
        dealt.select("_x._r.*", position.cast("long").alias("position"))
        .withColumn("shard", F.expr(f"cast(position * {n_shards} div {total} as int)"))
        .withColumn("slot", F.expr(f"position - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}"))
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder to a shard, rows in the order of their slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law `rows`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs, 8).select(
        "doc_id",
        n_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
