"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if the lengths differ or a number is missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_literal(a: Column) -> Column:
    """'[x,y,...]', as vector stores take it."""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>").cast("array<float>")
