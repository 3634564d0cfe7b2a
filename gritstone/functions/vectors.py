"""Column functions on dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    once = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    return F.flatten(F.transform(once, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x.cast("double")).otherwise(x / F.nullif(s["n"], F.lit(0.0))))))
