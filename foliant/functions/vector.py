"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    by = F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, n).otherwise(1.0)), F.lit(0))
    return F.get(F.transform(F.array(by), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def without_axis(a: Column, axis: Column) -> Column:
    """a less its part along a unit axis."""
    part = dot(a, axis)
    return F.get(F.transform(F.array(part), lambda p: F.zip_with(a, axis, lambda x, y: x.cast("double") - p * y.cast("double"))), F.lit(0))
