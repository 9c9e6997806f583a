"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own in the one that the cluster names in spark.checkpoint.dir; it goes when the session ends.

    Without that setting a folder of this machine serves a local session (tests, one machine); on a cluster that is an error,
    as driver and executors would each see their own."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        held = context._jsc.sc().getCheckpointDir()
    folder = f"{held.get()}/tessera-{context.applicationId}"
    path, files = _on_disk(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def _on_disk(spark: SparkSession, folder: str):
    """The JVM's path and file system of a folder."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder that nothing reads any more."""
    path, files = _on_disk(spark, folder)
    files.delete(path, True)


_INSIDE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes in this block are gone after it; what was made from them must have been written by then."""
    _INSIDE.append(f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        discard(spark, _INSIDE.pop())


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage: written to the shared folder as a table and read from there."""
    spark = df.sparkSession
    path = f"{_INSIDE[-1] if _INSIDE else shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use, as given but for what it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


#: Whole texts can be long, so few of them, and few bytes, go to a Python worker at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def bounded_batches() -> None:
    """Lowers the session's rows and bytes to an Arrow batch where they are Spark's defaults; a session's own choice stays.

    Spark reads these settings when a job starts, so they can't be put back when an operator returns its DataFrame."""
    spark = SparkSession.active()
    for key, (default, lower) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, lower)


def per_text(fn: Callable[[str], Sequence], schema: str) -> Callable[[Column], Column]:
    """A column function that gives each text (null: empty) to fn and returns a struct of its results."""
    names = [part.split()[0].strip(":") for part in _top_level(schema)]
    bounded_batches()

    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(t or "") for t in texts], columns=names)

    return apply


def _top_level(schema: str) -> list[str]:
    """The fields of a DDL string, cut at commas outside angle brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    """kind:start:end of each span, comma-joined, in the given order."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
