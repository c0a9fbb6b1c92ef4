"""Array arithmetic for feature vectors and padded sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_as_col(a), _as_col(b), lambda x, y: x * y))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_as_col(a), _as_col(b), lambda x, y: (x - y) * (x - y)))


def absolute_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_as_col(a), _as_col(b), lambda x, y: F.abs(x - y)))


def norm(a: str | Column) -> Column:
    return F.sqrt(total(F.transform(_as_col(a), lambda x: x * x)))


def normalise(a: str | Column) -> Column:
    a = _as_col(a)
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / length)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_squared_error(a: str | Column, b: str | Column) -> Column:
    return squared_distance(a, b) / F.size(_as_col(a))


def softmax(a: str | Column) -> Column:
    a = _as_col(a)
    top = F.array_max(a)
    return F.transform(a, lambda x: F.exp(x - top) / total(F.transform(a, lambda y: F.exp(y - top))))


def pad(a: str | Column, length: Column, fill: int = -1) -> Column:
    """Extend an array with ``fill`` up to ``length``."""
    a = _as_col(a)
    missing = F.greatest(length - F.size(a), F.lit(0)).cast("int")
    return F.concat(a, F.array_repeat(F.lit(fill).cast("int"), missing))


def head(a: str | Column, n: Column | int) -> Column:
    """First ``n`` elements (a keep-length cut of the tail)."""
    return F.slice(_as_col(a), 1, n)


def joined(a: str | Column) -> Column:
    """Comma-joined text of an array, for reports and comparisons."""
    return F.array_join(F.transform(_as_col(a), lambda x: x.cast("string")), ",")
