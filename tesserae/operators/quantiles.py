"""Exact quantiles by refinement: histograms narrowed digit by digit, without a sort.

A double is read as an unsigned integer of 64 bits in the same order. The first pass counts the
highest 16 bits of all values; the bin that holds a wanted rank gives the first digit of the value
at that rank. Each further pass counts the next digit of the values in such bins only, so four
passes name every bit of the wanted values. A pass shuffles counts of digits, at most 65,536 for
each rank, whatever the number of rows; no value is stored, sorted or sent.

Defined cases: NULL is no value; NaN comes after all numbers; -0.0 equals 0.0; ranks between two
values are interpolated; without values the quantiles are NULL. The table is read once per pass:
store it first where making it is dear.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits settled by one pass.
DIGIT_BITS = 16
WIDTH = 64
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    plain = values + 0.0
    plain[np.isnan(plain)] = np.nan
    bits = plain.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def of_bits(key: int) -> float:
    """The double of an integer made by :func:`ordered_bits`."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _digits(column: DataFrame, prefixes: list[int], done: int) -> DataFrame:
    """(place, digit, n): counts of the digit after the first ``done`` bits, by the place of the value's prefix."""
    known = np.array(prefixes, dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = ordered_bits(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            # A shift by the whole width is undefined, so the first pass has no prefix to look at.
            top = keys >> np.uint64(WIDTH - done) if done else np.zeros_like(keys)
            place = np.searchsorted(known, top)
            held = place < len(known)
            held[held] = known[place[held]] == top[held]
            digit = (keys[held] >> np.uint64(WIDTH - done - DIGIT_BITS)).astype(np.int64) & ((1 << DIGIT_BITS) - 1)
            slot, n = np.unique((place[held].astype(np.int64) << DIGIT_BITS) | digit, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot >> DIGIT_BITS), pa.array(slot & ((1 << DIGIT_BITS) - 1)), pa.array(n.astype(np.int64))],
                names=["place", "digit", "n"],
            )

    counts = column.mapInArrow(count, "place bigint, digit bigint, n bigint")
    return counts.groupBy("place", "digit").agg(F.sum("n").alias("n"))


def _ends(share: float, total: int) -> tuple[int, int, float]:
    """Ranks of the two values around a share, and the part of the way between them."""
    place = share * (total - 1)
    low = int(place)
    return low, min(low + 1, total - 1), place - low


def exact_percentiles(df: DataFrame, value: str | Column, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact percentiles with linear interpolation, at any size."""
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    spark = df.sparkSession
    column = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))
    in_prefix = Window.partitionBy("place")
    # One entry for every rank: the bits known so far, and the rank among the values that begin with them.
    known: list[int] = []
    ranks: list[int | Column] = []
    for share in shares:
        low = F.floor(F.lit(float(share)) * (F.col("total") - 1))
        ranks += [low, F.least(low + 1, F.col("total") - 1)]
        known += [0, 0]
    total = 0
    for done in range(0, WIDTH, DIGIT_BITS):
        prefixes = sorted(set(known))
        counts = _digits(column, prefixes, done)
        counts = counts.withColumns(
            {"upto": F.sum("n").over(in_prefix.orderBy("digit")), "total": F.sum("n").over(in_prefix)}
        )
        found = [
            F.min(
                F.when(
                    (F.col("place") == prefixes.index(prefix)) & (F.col("upto") > rank),
                    F.struct("digit", (F.col("upto") - F.col("n")).alias("before")),
                )
            ).alias(f"r{i}")
            for i, (prefix, rank) in enumerate(zip(known, ranks))
        ]
        row = counts.agg(F.max("total").alias("total"), *found).first()
        if row["total"] is None:
            return spark.createDataFrame([(float(s), None) for s in shares], "share double, value double")
        if not done:
            total = row["total"]
            ranks = [rank for share in shares for rank in _ends(share, total)[:2]]
        known = [prefix << DIGIT_BITS | row[f"r{i}"]["digit"] for i, prefix in enumerate(known)]
        ranks = [rank - row[f"r{i}"]["before"] for i, rank in enumerate(ranks)]
    out = []
    for i, share in enumerate(shares):
        low, high = of_bits(known[2 * i]), of_bits(known[2 * i + 1])
        part = _ends(share, total)[2]
        out.append((float(share), low if part == 0 or low == high else low + (high - low) * part))
    return spark.createDataFrame(out, "share double, value double")
