"""Seeded uniforms, rounding, clamping and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(*parts: str | Column) -> Column:
    """Uniform number in [0, 1) that depends only on the given seed parts.

    Unlike ``rand`` it does not depend on partitioning or task retries, so a recomputed
    task draws the same numbers. Use ``F.lit`` for constant parts.
    """
    text = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round half up to ``digits`` by scaling and flooring."""
    scale = float(10**digits)
    return F.floor(_as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(c: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(_as_col(c), F.lit(low)), F.lit(high))


def quantise_round(c: str | Column) -> Column:
    """Clamp to [0, 1], snap to the nearest 8-bit level and return it as a fraction."""
    return F.floor(clamp(c) * F.lit(255.0) + F.lit(0.5)) / F.lit(255.0)


def quantise_floor(c: str | Column) -> Column:
    """Truncate ``c * 255`` to an 8-bit integer."""
    return F.floor(_as_col(c) * F.lit(255.0)).cast("int")


def luma(r: str | Column, g: str | Column, b: str | Column) -> Column:
    """Grey value of an RGB pixel."""
    # The red, green and blue weights.
    return F.lit(0.2989) * _as_col(r) + F.lit(0.5870) * _as_col(g) + F.lit(0.1140) * _as_col(b)


def class_to_rg(c: str | Column) -> tuple[Column, Column]:
    """Encode a 16-bit class id in the red (low byte) and green (high byte) channels."""
    c = _as_col(c)
    return F.pmod(c, F.lit(256)), F.floor(c / 256)


def rg_to_class(r: str | Column, g: str | Column) -> Column:
    return _as_col(g) * 256 + _as_col(r)


def share_entropy(p: Column, eps: float) -> Column:
    """One term of a base-2 entropy, ``-p * log2(p + eps)``."""
    return -(p * F.log2(p + F.lit(eps)))
