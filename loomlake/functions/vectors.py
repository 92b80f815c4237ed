"""Column functions on arrays of numbers; sums are taken in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pick(a: Column, positions: Sequence[int]) -> Column:
    return F.array(*[F.element_at(a, p + 1) for p in positions])


def peak(a: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def active(a: Column) -> Column:
    return F.size(F.filter(a, lambda v: v > 0))


def sparse_code(a: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """ReLU(W(x - b)) for a weight matrix small enough for a plan; larger ones go through a broadcast and an Arrow function."""
    centred = F.zip_with(a, F.array(*map(F.lit, bias)), lambda x, b: x - b)
    return F.array(*[F.greatest(dot(centred, F.array(*map(F.lit, w))), F.lit(0.0)) for w in weights])


def sparse_decode(code: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """W'z + b, the reconstruction of a vector from its code."""
    return F.array(*[dot(code, F.array(*map(F.lit, column))) + b for column, b in zip(zip(*weights, strict=True), bias, strict=True)])
