"""Vector arithmetic as column expressions (accumulated in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def _usable(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def l2_norm(v: Column) -> Column:
    """Overflow-safe norm: scaled by the largest magnitude; 0 for the zero vector; NULL if invalid."""
    top = _max_abs(v)
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / top, F.lit(2.0)))
    return F.when(_usable(v), F.when(top == 0, 0.0).otherwise(top * F.sqrt(squares)))


def _dot(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") / sa) * (y.cast("double") / sb)), F.lit(0.0), lambda s, p: s + p
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; NULL for unequal or empty dimensions, non-finite or zero vectors."""
    sa, sb = _max_abs(a), _max_abs(b)
    raw = _dot(a, b, sa, sb) / F.sqrt(_dot(a, a, sa, sa)) / F.sqrt(_dot(b, b, sb, sb))
    ok = _usable(a) & _usable(b) & (F.size(a) == F.size(b)) & (sa > 0) & (sb > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
