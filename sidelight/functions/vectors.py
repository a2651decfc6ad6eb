"""Dense vectors as arrays of doubles; exact arithmetic, no approximate index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _scaled(v: Column, by: Column) -> Column:
    # the outer lambda binds the norm, which would else be computed for every component
    return F.transform(F.array(F.struct(v.cast("array<double>").alias("v"), by.alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def unit(v: Column) -> Column:
    """A stored vector at length 1; a zero vector stays zero."""
    n = norm(v)
    return _scaled(v, F.when(n == 0, F.lit(TINY)).otherwise(n))


def unit_query(v: Column) -> Column:
    """A query vector; its norm has a tiny value added, not only where it is zero."""
    return _scaled(v, norm(v) + F.lit(TINY))


def cosine_to(v: Column, u: Column) -> Column:
    """Of a stored vector and one of length 1; no scaled copy of the vector is made."""
    n = norm(v)
    return dot(v, u) / F.when(n == 0, F.lit(TINY)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def quantised(v: Column, digits: int = 5) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: F.round(x, digits).cast("float"))
