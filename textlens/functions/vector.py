"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(doubles(u), doubles(v), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vec), F.lit(0.0), lambda total, x: total + x * x))


def cosine(u: Column, v: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def unit(vec: Column) -> Column:
    """The vector scaled to length one; null for the zero vector, which has no direction."""
    values, length = doubles(vec), norm(vec)
    scaled = F.zip_with(values, F.array_repeat(length, F.size(values)), lambda x, by: F.try_divide(x, by))
    return F.when(length != 0, scaled)


def add(u: Column, v: Column) -> Column:
    return F.zip_with(doubles(u), doubles(v), lambda a, b: a + b)


def subtract(u: Column, v: Column) -> Column:
    return F.zip_with(doubles(u), doubles(v), lambda a, b: a - b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def interpolate(start: float, end: float, t: Column) -> Column:
    return F.lit(float(start)) * (F.lit(1.0) - t) + F.lit(float(end)) * t
