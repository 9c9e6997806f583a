"""Numbers and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 6) -> Column:
    return F.bround(x, digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has length 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def relative_delta(new: Column, old: Column) -> Column:
    """Null where the old value is 0."""
    return (new - old) / F.nullif(old, F.lit(0.0).cast("double"))


def finite(x: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def projected_cost(units: Column, per_hour: Column, price: Column) -> Column:
    """Hours that the units take, and their price."""
    hours = units / F.nullif(per_hour, F.lit(0.0).cast("double"))
    return F.struct(hours.alias("hours"), (hours * price).alias("cost"))
