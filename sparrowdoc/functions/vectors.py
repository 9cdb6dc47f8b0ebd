"""Vectors as ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rounded(value: Column, digits: int) -> Column:
    """To ``digits`` places, halves of the binary product away from zero (as SQL engines round doubles; Spark rounds the decimal form)."""
    return F.round(value * 10.0**digits) / 10.0**digits


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    """0 where either norm is (nearly) 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < least, F.lit(0.0)).otherwise(dot(a, b) / norm)
