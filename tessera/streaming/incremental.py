"""File streams with checkpoints: deduplication across scans, idempotent sinks, event-time windows, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of Parquet files as they come; writers must rename finished files into place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def distinct_texts(stream: DataFrame, fingerprint: Column) -> DataFrame:
    """The first row of each fingerprint ever seen. The state has no expiry: it grows with distinct texts."""
    return stream.withColumn("fingerprint", fingerprint).dropDuplicates(["fingerprint"])


def recent_distinct(stream: DataFrame, at: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark; older state goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table and ends; a rerun goes on where this one stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each batch to `write` with its number; a batch that runs again has the same number, so writes can be idempotent."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def overwrite_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def windowed_counts(stream: DataFrame, at: str, by: str, size: str, delay: str) -> DataFrame:
    """Counts and sums in event-time windows, late rows up to the delay."""
    held = stream.withWatermark(at, delay).groupBy(F.window(at, size), by)
    return held.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), by, "n", "total")


def sessions(df: DataFrame, at: str, user: str, gap: str) -> DataFrame:
    """Sessions that end after a gap; for streams and tables alike."""
    held = df.withWatermark(at, gap) if df.isStreaming else df
    return held.groupBy(user, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """A running count and sum for each key, kept as custom state."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame([(k[0], n, total)], columns=[key, "n", "total"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def same_source(identity: dict, held: dict | None) -> None:
    """Fails if a resumed run's source or tokenizer isn't the one that it began with."""
    if held is not None and held != identity:
        raise ValueError("the source or the tokenizer has changed since this run began")
