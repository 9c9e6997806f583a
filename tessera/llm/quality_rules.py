"""Quality rules by compression bands (operator 10).

Every whole text is compressed with zstandard, once as a whole and once in fixed chunks. Text that compresses far
better than the corpus's own texts of its length (repetition, tables, filler) or far worse (noise, encoded binary)
leaves its band and is rejected, and so is a text of which many chunks leave theirs. What a normal ratio is depends on
the length, as a compressor needs some text before it finds anything, so each length class (a quarter of a doubling of the bytes)
has its own limits: the class's median of the ratio's logarithm, `WIDTH` robust deviations (median absolute deviation)
to either side. They are counted over all documents, exactly, from a histogram of a few thousand bins.

Texts of the same length and packed length count once in the histogram, so a large group of copies doesn't become the
norm. A class of fewer than `LEAST_TEXTS` such texts is measured together with the classes next to it, as many as it
takes; a deviation is at least `LEAST_SPREAD`, so near copies don't narrow a band to nothing.

Defined cases: a null text counts as empty; an empty text has ratio 1 and no chunks, and the base
rule (fewer than 50 words) rejects it; repeated rows get the same verdict each; an empty table gives
an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WHITE, per_text, table

SYMBOLS = "#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 4096
#: Robust deviations from the median that a band is wide, to either side.
WIDTH = 5.0
LEAST_SPREAD = 0.02
#: Texts that a length class takes its limits from, at least.
LEAST_TEXTS = 50
#: Length classes to a doubling of the bytes, and in all.
PER_DOUBLING, CLASSES = 4, 160
#: Bins to a unit of the ratio's natural logarithm.
BINS = 1000
#: A text is rejected when at least this share of its chunks leaves the band of their length.
BAD_CHUNK_SHARE = 0.25
#: A last chunk shorter than this says too little.
LEAST_CHUNK = 1024
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"
)


def repeated_window_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of so many words which the text holds at least twice."""
    n = len(words)
    if n <= width:
        return 0
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    if len(first) == n:
        return 0
    keys = ids[: n - width + 1]
    for step in range(1, width):
        keys = keys * n + ids[step : n - width + 1 + step]
        if step < width - 1 and n > 1_000_000:  # keeps the keys inside 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n, bool)
    for step in range(width):
        covered[at + step] = True
    return int(covered.sum())


class Compressor:
    """Made on first use in each Python worker; zstandard objects can't be sent there."""

    made: zstandard.ZstdCompressor | None = None

    @classmethod
    def packed(cls, data) -> int:
        cls.made = cls.made or zstandard.ZstdCompressor(level=LEVEL)
        return len(cls.made.compress(data))


def chunks(data: bytes) -> Iterator[memoryview]:
    """The fixed chunks of a text, without a last one that says too little."""
    view = memoryview(data)
    for at in range(0, len(data) - LEAST_CHUNK + 1, CHUNK_BYTES):
        yield view[at : at + CHUNK_BYTES]


def limits_of(counted: Iterable[tuple[int, int, int]]) -> dict[int, tuple[float, float]]:
    """Lowest and highest ratio of each length class, from (class, bin, count)."""
    held = np.array(sorted(counted), np.int64).reshape(-1, 3)
    out = {}
    for c in range(CLASSES):
        for reach in range(CLASSES + 1):
            near = held[np.abs(held[:, 0] - c) <= reach]
            if near[:, 2].sum() >= LEAST_TEXTS or reach == CLASSES:
                break
        if len(near):
            mid = median(near[:, 1], near[:, 2])
            spread = max(LEAST_SPREAD, 1.4826 * median(np.abs(near[:, 1] - mid), near[:, 2]) / BINS)
            out[c] = (math.exp(mid / BINS - WIDTH * spread), math.exp(mid / BINS + WIDTH * spread))
    return out


def median(values: np.ndarray, counts: np.ndarray) -> int:
    """The lower median of values that occur so often."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(counts[order])
    return int(values[order][np.searchsorted(total, (total[-1] + 1) // 2)])


def class_of(n_bytes: int) -> int:
    """The length class of a text that isn't empty."""
    return min(CLASSES - 1, int(PER_DOUBLING * math.log2(n_bytes)))


def sized(data) -> tuple[int, int, int, int]:
    """(length class, bin of the ratio, bytes, packed bytes)."""
    n, packed = len(data), Compressor.packed(data)
    return class_of(n), round(BINS * math.log(packed / n)), n, packed


class Limits:
    """The bands of whole texts and of chunks, by length class."""

    def __init__(self, whole: dict[int, tuple[float, float]], chunk: dict[int, tuple[float, float]]) -> None:
        self.whole, self.chunk = whole, chunk

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text") -> Limits:
        """Counted over all texts of docs; one row for each length class and bin comes to the driver."""

        def measure_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for text in batch["text"]:
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if data:
                        rows.append((True, *sized(data)))
                        rows.extend((False, *sized(part)) for part in chunks(data))
                yield pd.DataFrame(rows, columns=["whole", "grade", "bin", "n", "packed"]).drop_duplicates()

        sizes = docs.select(F.col(text_col).alias("text")).mapInPandas(measure_sizes, "whole boolean, grade long, bin long, n long, packed long").distinct()
        got = sizes.groupBy("whole", "grade", "bin").agg(F.count("*").alias("n")).collect()
        of = lambda whole: limits_of((r["grade"], r["bin"], r["n"]) for r in got if r["whole"] == whole)
        return cls(of(True), of(False))


EVERY = (0.0, math.inf)


def measure(text: str, limits: Limits) -> tuple:
    """One text's counts, base rule and compression verdict."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    n_repeat = repeated_window_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words

    ratio = Compressor.packed(data) / len(data) if data else 1.0
    low, high = limits.whole.get(class_of(len(data)), EVERY) if data else EVERY
    n_chunks = n_bad = 0
    for part in chunks(data):
        least, most = limits.chunk.get(class_of(len(part)), EVERY)
        n_chunks += 1
        n_bad += not least <= Compressor.packed(part) / len(part) <= most
    if ratio < low:
        reason = "repetitive"
    elif ratio > high:
        reason = "incompressible"
    elif n_bad and n_bad >= BAD_CHUNK_SHARE * n_chunks:
        reason = "chunks"
    else:
        reason = ""
    kept = not base_failed and not reason
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, base_failed, kept, ratio, n_chunks, n_bad, "base" if base_failed else reason


def with_quality_rules(docs: DataFrame, text_col: str = "text", into: str = "quality_rules", limits: Limits | None = None) -> DataFrame:
    """docs with a struct of counts and verdict in the column `into` (an own column of that name is replaced).

    limits: bands fitted elsewhere; by default those of docs themselves."""
    limits = limits or Limits.fit(docs, text_col)
    return docs.withColumn(into, per_text(lambda text: measure(text, limits), RESULT)(F.col(text_col)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality_rules(docs).select("doc_id", "quality_rules.*")
