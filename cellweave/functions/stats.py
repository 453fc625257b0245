"""Named normalisations and small vector expressions.

The four z-score rules differ in their guard and must not be mixed up; each has its name.
All use the population deviation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def zscore_shifted(value: Column, mean: Column, std: Column, delta: float) -> Column:
    """(v - mean) / (std + delta)."""
    return (value - mean) / (std + F.lit(delta))


def zscore_floored(value: Column, mean: Column, std: Column, eps: float) -> Column:
    """(v - mean) / max(std, eps)."""
    return (value - mean) / F.greatest(std, F.lit(eps))


def zscore_guarded(value: Column, mean: Column, std: Column, delta: float) -> Column:
    """0 where std <= delta, otherwise the shifted form."""
    return F.when(std <= delta, F.lit(0.0)).otherwise((value - mean) / (std + F.lit(delta)))


def zscore_small_group(value: Column, mean: Column, std: Column, size: Column, delta: float = 1.0e-8) -> Column:
    """0 for groups of at most one row, otherwise the shifted form."""
    return F.when(size <= 1, F.lit(0.0)).otherwise((value - mean) / (std + F.lit(delta)))


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def add_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def vector_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` and its lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def softmax(scores: Column) -> Column:
    def shares(weights: Column) -> Column:
        return bound(vector_sum(weights), lambda total: F.transform(weights, lambda w: w / total))

    return bound(F.array_max(scores), lambda top: bound(F.transform(scores, lambda v: F.exp(v - top)), shares))


def softmax_max(scores: Column) -> Column:
    """Largest softmax probability: 1 / sum(exp(s - max))."""
    return bound(scores, lambda s: bound(F.array_max(s), lambda top: F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda t, v: t + F.exp(v - top))))


def logsumexp(values: Column) -> Column:
    return bound(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
