"""Shards cut from a Hilbert curve over several metadata dimensions.

Every dimension is quantised to cells of about equal row counts, the cells of a row give its
index on the Hilbert curve, rows are sorted by that index, and the order is cut into runs
whose row counts differ by one at most. Neighbours on the curve are neighbours in every
dimension, so a file holds a small box of the metadata space and readers can skip files by
the minimum and maximum of any dimension.

Sorting is a range partitioning on (index, tie-break), which divides a cell with a third of
all rows over many tasks. Positions come from local row numbers plus one start per range
slice; the sorted rows are stored once so that both uses see the same slices.

Strings are cut by their whole order, however long a beginning they share, and numbers by their
value with fractions.

Defined cases: null metadata has a cell of its own before every value; equal rows sit side by side in any
order; with fewer rows than shards some shards are empty; an empty table gives an empty
table; columns of the input named like the results (``shard``, ``slot``) are replaced, all
others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    TimestampType,
)

from tesserae.llm.names import fresh
from tesserae.operators.ordering import running_totals
from tesserae.session import materialise

#: Bits per dimension.
BITS = 6
_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row in 33 bits


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points given by one array of cell numbers per dimension.

    Works on the axes in place of coordinates: rotations are undone from the top bit down,
    the result is Gray-coded, and its bits are interleaved.
    """
    x = [np.asarray(c).astype(np.int64) for c in cells]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(hit, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1, turn ^ ((1 << b) - 1), turn)
    x = [v ^ turn for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def _plain(df: DataFrame, name: str) -> Column:
    """A column as a long, a double or a string in the same order."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType, BooleanType)):
        return column.cast("bigint")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, (FloatType, DoubleType, DecimalType)):
        return column.cast("double")
    # Two digits a byte keep the order of bytes.
    return F.hex(column) if isinstance(kind, BinaryType) else column.cast("string")


def _limits(values: DataFrame, name: str, cells: int) -> list:
    """At most ``cells - 1`` values that cut the rows into cells of about equal counts."""
    rows = values.select(F.col(name).alias("v")).filter("v IS NOT NULL")
    if not isinstance(values.schema[name].dataType, StringType):
        ranks = F.array(*[F.lit(i / cells) for i in range(1, cells)])
        found = rows.agg(F.percentile_approx("v", ranks, 10_000).alias("q")).first()["q"]
        return sorted(set(found or []))
    # Strings by their whole order: running counts of different values, sorted in slices.
    counts = running_totals(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")), [], ["v"], {"upto": "n"})
    counts = materialise(counts)
    total = counts.agg(F.max("upto")).first()[0]
    if not total:
        return []
    rank = lambda c: F.floor(c * cells / total)
    edges = counts.filter((rank(F.col("upto")) > rank(F.col("upto") - F.col("n"))) & (F.col("upto") < total))
    return sorted(r["v"] for r in edges.select("v").collect())


def with_curve(df: DataFrame, dimensions: Sequence[str], name: str, bits: int = BITS) -> DataFrame:
    """Add the Hilbert index as ``name``. Cell limits are quantiles over all rows, fewer than 2**bits a dimension.

    Cell 0 of a dimension is that of null.
    """
    values = df.select(*[_plain(df, d).alias(f"d{i}") for i, d in enumerate(dimensions)])
    edges = []
    for field in values.schema.fields:
        kind = object if isinstance(field.dataType, StringType) else np.float64 if isinstance(field.dataType, DoubleType) else np.int64
        edges.append(np.array(_limits(values, field.name, (1 << bits) - 1), dtype=kind))

    @F.pandas_udf(LongType())
    def index(columns: pd.DataFrame) -> pd.Series:
        cells = []
        for i, e in enumerate(edges):
            none, value = columns[f"n{i}"].to_numpy(), columns[f"d{i}"].to_numpy()
            cells.append(np.where(none, 0, 1 + np.searchsorted(e, value.astype(e.dtype), side="left")))
        return pd.Series(hilbert_index(cells, bits))

    def filled(i: int, d: str) -> list[Column]:
        value, kind = _plain(df, d), values.schema[f"d{i}"].dataType
        least = F.lit("") if isinstance(kind, StringType) else F.lit(0).cast(kind)
        return [F.coalesce(value, least).alias(f"d{i}"), value.isNull().alias(f"n{i}")]

    return df.withColumn(name, index(F.struct(*[c for i, d in enumerate(dimensions) for c in filled(i, d)])))


def assign(df: DataFrame, dimensions: Sequence[str], ties: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, 0-based, gapless in its shard).

    ``ties`` are columns that order rows of one cell; rows equal in them too may change places.
    """
    df = df.drop("shard", "slot")
    curve, part, row = fresh(df, "curve"), fresh(df, "part"), fresh(df, "row")
    order = [F.col(curve), *[F.col(f"`{t}`") for t in ties]]
    rows = materialise(
        with_curve(df, dimensions, curve, bits)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)))
    )
    # One row per range slice reaches the driver and is sent to the tasks.
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect()
    total = sum(s["n"] for s in sizes)
    starts, at = [], 0
    for s in sizes:
        starts.append((s[part], at))
        at += s["n"]
    spark = df.sparkSession
    starts = spark.createDataFrame(starts, f"`{part}` int, `{row}_start` bigint")
    place = F.col(row) + F.col(f"{row}_start")
    shard = F.expr(f"CAST((`{row}` + `{row}_start`) * {shards} DIV {max(total, 1)} AS INT)")
    begin = F.expr(f"(CAST(`shard` AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    out = rows.join(F.broadcast(starts), part).withColumn("shard", shard)
    return out.withColumn("slot", place - begin).drop(curve, part, row, f"{row}_start")
