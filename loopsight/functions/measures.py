"""Column functions for similarities and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """In double, clamped to [-1, 1]; 0 if either is a zero vector; null if the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))
    return F.when(F.size(a) == F.size(b), value)


def checked_cosine(a: Column, b: Column) -> Column:
    """``cosine``, where vectors of different lengths are an error."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.format_string("vectors of %d and %d components", F.size(a), F.size(b))).cast("double")).otherwise(cosine(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def iou(a: Column, b: Column) -> Column:
    """As jaccard, but 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Share, lower and upper bound; (0, 0, 1) without trials; an error for counts that make no sense."""
    ok = (n >= 0) & (hits >= 0) & (hits <= n)
    p, z2 = hits / n, F.lit(z * z)
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    guard = lambda none, value: F.when(~ok, F.raise_error(F.lit("hits must be between 0 and n")).cast("double")).when(n == 0, none).otherwise(value)
    return guard(0.0, p), guard(0.0, F.greatest(F.lit(0.0), middle - spread)), guard(1.0, F.least(F.lit(1.0), middle + spread))
