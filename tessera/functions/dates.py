"""Years, centuries, periods and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_bucket(death_years: Column) -> Column:
    """By the latest death year; any unknown year makes the period unknown."""
    latest = F.array_max(death_years)
    unknown = (F.size(death_years) <= 0) | F.exists(death_years, lambda y: y.isNull()) | death_years.isNull()
    return F.when(unknown, "unknown").when(latest <= 1800, "origins_through_1800").when(latest <= 1900, "nineteenth_century_bridge").otherwise("author_died_after_1900_review")


def years(text: Column, beside: str = "0-9") -> Column:
    """Four-digit years from 1000 to 2099 that stand alone: no character of the class `beside` touches them."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![{beside}])(1\d{{3}}|20\d{{2}})(?![{beside}])")), lambda y: y.cast("int"))


def standalone_year(line: Column) -> Column:
    """The year of a line that holds nothing else, else null."""
    return F.regexp_extract(line, r"^[\s(\[]*((?:1\d{3}|20\d{2}))[\s)\].,]*$", 1).try_cast("int")


def roman(text: Column) -> Column:
    """Value of a Roman numeral; null if it isn't one."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    upper = F.upper(F.trim(text))
    digits = F.transform(F.filter(F.split(F.reverse(upper), ""), lambda c: c != ""), lambda c: value[c])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    step = lambda s, d: F.struct((s["total"] + F.when(d < s["top"], -d).otherwise(d)).alias("total"), F.greatest(s["top"], d).alias("top"))
    return F.when(upper.rlike("^(?=[IVXLCDM])M*(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"), F.aggregate(digits, start, step)["total"])


def century_interval(century: Column) -> Column:
    """First and last year of a century."""
    return F.struct(((century - 1) * 100 + 1).alias("year_start"), (century * 100).alias("year_end"))


def earliest_by_kind(evidence: Column, kind: str) -> Column:
    """The earliest interval of a kind among structs (year_start, year_end, kind, ...)."""
    return F.array_min(F.filter(F.array_distinct(evidence), lambda e: e["kind"] == kind))


def wiki_timestamp(text: Column) -> Column:
    """14 digits to a timestamp; null if they don't make one."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def duration(seconds: Column) -> Column:
    """h:mm:ss"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)


def byte_size(n: Column) -> Column:
    """With the largest binary unit that leaves at least 1."""
    unit = lambda k, name: F.format_string(f"%.1f {name}", n / float(1 << k))
    return F.when(n >= 1 << 30, unit(30, "GiB")).when(n >= 1 << 20, unit(20, "MiB")).when(n >= 1 << 10, unit(10, "KiB")).otherwise(F.format_string("%d B", n.cast("long")))
