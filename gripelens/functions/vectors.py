"""Expressions over array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def on_sphere(v: Column) -> Column:
    """Unit vector with one extra coordinate that only the zero vector fills.

    Squared distances between such vectors are twice the cosine distance, and a
    zero vector is at cosine distance 1 from all others.
    """
    length = norm(v)
    return F.when(
        length > 0, F.concat(F.transform(v, lambda x: x / length), F.array(F.lit(0.0)))
    ).otherwise(F.concat(F.transform(v, lambda x: x * 0.0), F.array(F.lit(1.0))))
