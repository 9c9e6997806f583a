"""Joins and windows with contracts: unique keys, strict one-to-one, set differences, as-of, ranges, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df; fails now if a key occurs twice."""
    if bad := duplicates(df, *key).limit(3).collect():
        raise ValueError(f"keys occur more than once: {[tuple(r) for r in bad]}")
    return df


def overwrite_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns in place of its own; a left key that right lacks is an error."""
    if bad := left.join(right, key, "left_anti").select(key).limit(3).collect():
        raise ValueError(f"keys without a match: {[r[0] for r in bad]}")
    shared = [c for c in left.columns if c in right.columns and c != key]
    return left.drop(*shared).join(right, key)


def disagreements(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, problem): keys that one side lacks and fields that differ; empty if the two agree row by row."""
    a, b = left.select(key, *fields).alias("a"), right.select(key, *fields).alias("b")
    held = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    problems = [F.when(F.col(f"a.{key}").isNull(), "missing left"), F.when(F.col(f"b.{key}").isNull(), "missing right")]
    both = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    problems += [F.when(both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f"differs: {f}") for f in fields]
    return held.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def set_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that are missing or unexpected."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionAll(found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("unexpected")))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def title_author_join(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """(key, matches): equal title keys and a common author word, an empty author list matching any.

    left and right hold (key, title_key, authors); right's id column is `other`."""
    a, b = left.alias("a"), right.alias("b")
    fits = (F.size("a.authors") == 0) | (F.size("b.authors") == 0) | F.arrays_overlap("a.authors", "b.authors")
    held = a.join(b, F.col("a.title_key") == F.col("b.title_key")).filter(fits)
    return held.groupBy(F.col(f"a.{key}").alias(key)).agg(F.array_sort(F.collect_set(F.col(f"b.{other}"))).alias("matches"))


def others_with_key(df: DataFrame, key: str, *composite: str) -> DataFrame:
    """df with `others`: ids that share the composite key, itself left out."""
    every = F.array_sort(F.collect_list(key).over(W.partitionBy(*composite)))
    return df.withColumn("others", F.array_except(every, F.array(F.col(key))))


def linked_names(links: DataFrame, roots: DataFrame, targets: DataFrame, page: str, target: str, name: str) -> DataFrame:
    """(page, names): names of the targets that root pages link to."""
    held = links.join(roots.select(page).distinct(), page, "left_semi").join(targets, target)
    return held.groupBy(page).agg(F.array_sort(F.collect_set(name)).alias("names"))


def scan_chain(pages: DataFrame, index_links: DataFrame, index_pages: DataFrame, page: str, index: str) -> DataFrame:
    """pages with their index targets and those pages; what is missing stays null."""
    return pages.join(index_links, page, "left").join(index_pages, index, "left")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """left with the latest earlier-or-equal value of right in the same group: one union and one window, no range join."""
    kinds = dict(right.dtypes)
    l = left.withColumns({"_v": F.lit(None).cast(kinds[value]), "_l": F.lit(1)})  # noqa: E741
    r = right.select(*by, at, F.col(value).alias("_v")).withColumn("_l", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    upto = W.partitionBy(*by).orderBy(at, "_l").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_l") == 0, F.struct("_v")), ignorenulls=True).over(upto)
    return both.withColumn("as_of", seen["_v"]).filter("_l = 1").drop("_v", "_l")


def range_overlap(left: DataFrame, right: DataFrame, by: Sequence[str], bucket: int) -> DataFrame:
    """left x right on overlapping [start, stop) of the same group, with `overlap`: spans are dealt to buckets they meet.

    A pair is counted in the bucket where its overlap begins, so it comes once."""
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest(F.col("stop") - 1, "start")) / bucket))))
    a, b = spread(left).alias("a"), spread(right).alias("b")
    on = F.col("a._b") == F.col("b._b")
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    size = F.least("a.stop", "b.stop") - F.greatest("a.start", "b.start")
    first = F.floor(F.greatest("a.start", "b.start") / bucket) == F.col("a._b")
    held = a.join(b, on).withColumn("overlap", size).filter((F.col("overlap") > 0) & first)
    return held.select("a.*", *[F.col(f"b.{c}").alias(f"right_{c}") for c in right.columns if c not in by], "overlap").drop("_b")


def sequence_gaps(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose value isn't their place in 1..n."""
    place = F.row_number().over(W.partitionBy(group).orderBy(value))
    return df.withColumn("place", place).filter(F.col("place") != F.col(value))


def first_last(df: DataFrame, group: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """First and last row of each group, by aggregates that combine before the shuffle."""
    row, at = F.struct(*fields), F.struct(*order)
    return df.groupBy(group).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"), F.count("*").alias("n"))


def occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with the number of each occurrence of a key and how often it occurs."""
    by = W.partitionBy(key)
    return df.withColumn("occurrence", F.row_number().over(by.orderBy(order))).withColumn("of", F.count("*").over(by))


def hierarchy(df: DataFrame, root: str, title: str) -> DataFrame:
    """df with place, depth and relative title of subpages: the root page first, then by lower-case title."""
    by = W.partitionBy(root).orderBy(F.col(title) != F.col(root), F.lower(title), title)
    relative = F.when(F.startswith(F.col(title), F.concat(F.col(root), F.lit("/"))), F.substring(F.col(title), F.length(root) + 2, F.length(title))).otherwise(F.lit(""))
    depth = F.when(relative == "", 0).otherwise(F.size(F.split(relative, "/")))
    return df.withColumn("place", F.row_number().over(by)).withColumn("relative", relative).withColumn("depth", depth)


def union_unique(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows with `component`, the number of their table; a key that occurs twice is an error."""
    out = None
    for i, df in enumerate(frames):
        held = df.withColumn("component", F.lit(i))
        out = held if out is None else out.unionByName(held, allowMissingColumns=True)
    return require_unique(out, key)


def append_new(base: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """base and those new rows whose id and text it doesn't hold."""
    fresh = new.join(base, key, "left_anti")
    known = base.select(T.sha(F.col(text)).alias("_fp")).distinct()
    fresh = fresh.withColumn("_fp", T.sha(F.col(text))).join(known, "_fp", "left_anti").drop("_fp")
    return base.unionByName(fresh)


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the listed ids; an id that df lacks is an error."""
    if bad := ids.join(df, key, "left_anti").select(key).limit(3).collect():
        raise ValueError(f"ids that aren't there: {[r[0] for r in bad]}")
    return df.join(ids.select(key).distinct(), key, "left_anti")


def transclude(pages: DataFrame, parts: DataFrame, page: str, titles: str, title: str, text: str) -> DataFrame:
    """(page, text, missing): the listed pages' texts in their order; titles without a page are counted."""
    listed = pages.select(page, F.posexplode(titles).alias("_at", title))
    held = listed.join(parts.select(title, text), title, "left").groupBy(page)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text))), lambda x: x[text]), "\n")
    return held.agg(joined.alias("text"), F.count_if(F.col(text).isNull()).alias("missing"))
