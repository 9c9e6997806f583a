"""Sinks: CSV, reports, bounded shards, token tables, publication by staging and rename."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sha
from tessera.operators.relate import require_unique
from tessera.operators.tokens import bounded_shards, offsets


def csv(df: DataFrame, path: str, fields: Sequence[str], order: str, one_file: bool = False) -> None:
    """The fields in order, rows sorted, keys unique. One file only for small tables."""
    held = require_unique(df.select(*fields), order).orderBy(order)
    (held.coalesce(1) if one_file else held).write.option("header", True).option("escape", '"').csv(path)


def json_report(df: DataFrame, most: int = 10_000) -> str:
    """A small aggregate as JSON text; more rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)


def markdown_report(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]) + "\n"


def text_shards(df: DataFrame, path: str, key: str, text: str, limit: int = 48 << 20) -> DataFrame:
    """Writes texts to shards of bounded bytes and returns the index: key, shard, start, stop, sha256.

    Offsets come from a fold over (key, size); the texts themselves are written by shard in parallel."""
    sized = df.select(key, text, F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("_size"))
    placed = bounded_shards(sized, key, "_size", limit)
    placed.select(key, text, "shard", "start").repartition("shard").sortWithinPartitions("shard", "start").select("shard", key, text).write.partitionBy("shard").parquet(path)
    return placed.select(key, "shard", "start", "stop", sha(F.col(text)).alias("sha256"))


def token_table(df: DataFrame, path: str, pool: str, order: str, tokens: str, target: int = 1 << 24) -> None:
    """Tokens with their place in the pool's stream and the shard of that place."""
    placed = offsets(df.withColumn("_n", F.size(tokens)), pool, order, "_n").drop("_n")
    placed.withColumn("shard", F.floor(F.col("first") / target)).write.partitionBy(pool, "shard").parquet(path)


def publish(spark: SparkSession, df: DataFrame, path: str, checks: Sequence[Callable[[DataFrame], bool]] = ()) -> None:
    """Writes beside the target, reads back, checks, then puts it in the target's place; the old one returns if that fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    staged, old, target = of(path + ".staged"), of(path + ".old"), of(path)
    fs = target.getFileSystem(conf)
    fs.delete(staged, True)
    df.write.parquet(path + ".staged")
    back = spark.read.parquet(path + ".staged")
    if not all(check(back) for check in checks):
        fs.delete(staged, True)
        raise ValueError("the staged table fails a check")
    fs.delete(old, True)
    had = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't rename to {path}")
    fs.delete(old, True)
