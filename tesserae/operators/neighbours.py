"""Nearest code book entries, k nearest neighbours and manifold membership.

Two physical forms are used. A code book up to ``MAX_CODEBOOK`` entries goes to every task
and each Arrow batch is one matrix product. Everything larger is a blocked join: points
and queries get the cell of their nearest pivot, cells are cut into blocks of about
``BLOCK_ROWS`` rows, pairs of cells that cannot matter are ruled out by the triangle
inequality, and blocks are gathered in groups of up to ``GROUP_ROWS`` rows: a row is sent once
to each group of the other side, whatever the number of its cells, and a pair of groups returns
only a few values per query. No pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import vectors as vec
from tesserae.functions.core import uniform
from tesserae.operators.ordering import number_rows
from tesserae.session import materialise

#: Largest code book that is sent to every task.
MAX_CODEBOOK = 16_384
#: Aimed-at rows per block, and per group of blocks; a task holds one group of each side.
BLOCK_ROWS = 4096
GROUP_ROWS = 32_768
#: Groups a side has at least, where it has as many blocks.
MIN_GROUPS = 8
#: Distances a task holds at once.
TILE = 4 << 20
#: Pairs of rows whose differences a task holds at once.
PAIRS = 1 << 16
#: Cells in which a query looks first, at most an eighth of all.
NEAR_CELLS = 8
#: Most cells the points are divided into, and the points a cell should have at least.
MAX_PIVOTS = 256
CELL_ROWS = 1024
#: Added to squared distances in the realism score.
REALISM_EPS = 1e-5

_SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    rows = column.tolist()
    if rows and all(isinstance(v, np.ndarray) and v.shape == rows[0].shape for v in rows):
        return np.concatenate(rows).reshape(len(rows), -1).astype(np.float64, copy=False)
    return np.array(rows, dtype=np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.maximum(out, 0.0)


def _screened(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, point, squared distance) of all pairs within ``limit`` of their row, some at a time in the order of rows.

    A product of 32 bits rules pairs out, with a margin above its error; the distances of the few
    that are left come from differences of 64 bits. Pairs a little beyond the limit may be among them.
    """
    # Nearer to the origin, the error is smaller.
    middle = b.mean(0)
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    scale = float((np.sqrt(xx.max()) + np.sqrt(yy.max())) ** 2)
    kind = np.float32 if 1e-20 < scale < 1e30 else np.float64
    margin = 8.0 * (a.shape[1] + 16) * np.finfo(kind).eps * scale
    left = np.concatenate([-2.0 * x, np.ones((len(x), 1))], axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate([y, yy[:, None]], axis=1).astype(kind).T)
    top = (limit + margin - xx).astype(kind)
    step = _tile(len(b))
    for start in range(0, len(a), step):
        # What is no number stays.
        near = np.flatnonzero(~(left[start : start + step] @ right > top[start : start + step, None]))
        for low in range(0, len(near), PAIRS):
            row, at = np.divmod(near[low : low + PAIRS], len(b))
            apart = a[start + row] - b[at]
            yield start + row, at, np.einsum("ij,ij->i", apart, apart)


def collect_codebook(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, entries) in code order, or ``None`` when the code book is too large to send."""
    rows = codebook.select("code", "e").limit(MAX_CODEBOOK + 1).collect()
    if len(rows) > MAX_CODEBOOK:
        return None
    return _book(rows)


def _book(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda x: x["code"])
    return np.array([x["code"] for x in rows]), np.array([x["e"] for x in rows], dtype=np.float64)


def codebook_slices(codebook: DataFrame) -> Iterator[np.ndarray]:
    """The entries in code order, at most ``MAX_CODEBOOK`` at a time."""
    book = collect_codebook(codebook)
    if book is not None:
        yield book[1]
        return
    placed = number_rows(codebook.select("code", "e"), [], ["code"], "_place")
    count = placed.count()
    for first in range(0, count, MAX_CODEBOOK):
        rows = placed.filter((F.col("_place") > first) & (F.col("_place") <= first + MAX_CODEBOOK))
        yield _book(rows.collect())[1]


def _add_column(df: DataFrame, name: str, kind: str, make: Callable[[pd.DataFrame], list]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(**{name: make(batch)})

    return df.mapInPandas(task, f"{schema}, `{name}` {kind}")


def codebook_products(
    vectors: DataFrame, codebook: DataFrame, column: str, name: str, scale: float = 1.0
) -> DataFrame:
    """Add the array of scaled dot products with all code book entries, in code order.

    A code book above ``MAX_CODEBOOK`` entries is sent in slices, one after the other.
    """
    out = vectors.drop(name)
    for i, entries in enumerate(codebook_slices(codebook)):
        part = name if i == 0 else "_more"
        out = _add_column(out, part, "array<double>", lambda b, m=entries.T * scale: list(_matrix(b[column]) @ m))
        if i:
            out = out.withColumn(name, F.concat(name, "_more")).drop("_more")
    return out


def nearest_code(
    vectors: DataFrame, codebook: DataFrame, column: str, normalise: bool = False, key: str = "image_id"
) -> DataFrame:
    """Add ``code`` and ``distance`` (squared) of the nearest entry; equal distances give the
    lowest code. Vectors and entries are scaled to unit length first when asked."""
    book = collect_codebook(codebook)
    if book is None:
        # Rows get a number of their own, as the key may repeat or be no number.
        rows = materialise(vectors.withColumn("_row", F.monotonically_increasing_id()))
        left, right = F.col(column), F.col("e")
        if normalise:
            left, right = vec.normalise(column), vec.normalise("e")
        found = nearest(
            rows.select(F.col("_row").alias("id"), left.alias("v")),
            codebook.select(F.col("code").alias("id"), right.alias("v")),
            1,
        )
        found = found.select(F.col("id").alias("_row"), F.col("other").cast("bigint").alias("code"), "distance")
        return rows.join(found, "_row").drop("_row")
    codes, entries = book

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if normalise else m

    entries = unit(entries)

    def find(batch: pd.DataFrame) -> list:
        d = _squared(unit(_matrix(batch[column])), entries)
        at = d.argmin(1)
        return [{"code": int(codes[i]), "distance": float(d[r, i])} for r, i in enumerate(at)]

    out = _add_column(vectors, "_near", "struct<code: bigint, distance: double>", find)
    return out.select("*", "_near.code", "_near.distance").drop("_near")


def entry_of_code(rows: DataFrame, codebook: DataFrame, code: str = "code", normalise: bool = False) -> DataFrame:
    """Add the code book vector ``e`` of each code, scaled to unit length when asked."""
    from tesserae.session import broadcast_if_small

    book = codebook.select(F.col("code").alias("_code"), vec.normalise("e").alias("e") if normalise else "e")
    return rows.join(broadcast_if_small(book, MAX_CODEBOOK), F.col(code) == F.col("_code"), "left").drop("_code")


def soft_entry(rows: DataFrame, codebook: DataFrame, weights: str, name: str = "z") -> DataFrame:
    """Add the weighted sum of code book entries; ``weights`` is in code order.

    A code book above ``MAX_CODEBOOK`` entries is sent in slices whose sums are added.
    """
    out, first = rows.drop(name), 0
    for i, entries in enumerate(codebook_slices(codebook)):
        part, last = name if i == 0 else "_more", first + len(entries)
        out = _add_column(
            out, part, "array<double>", lambda b, m=entries, f=first, t=last: list(_matrix(b[weights])[:, f:t] @ m)
        )
        if i:
            out = out.withColumn(name, F.zip_with(name, "_more", lambda x, y: x + y)).drop("_more")
        first = last
    return out


# blocked join -------------------------------------------------------------------------


class _Cells:
    """Pivots and per-cell summaries; bounded by ``MAX_PIVOTS`` whatever the data size."""

    def __init__(self, points: DataFrame, total: int):
        count = int(min(MAX_PIVOTS, max(1, total // CELL_ROWS)))
        # A fixed pseudo-random choice: the same pivots in every run and every retry.
        drawn = points.select("v", uniform(F.lit("pivot"), "id").alias("d"), "id")
        rows = drawn.orderBy("d", "id").limit(count).collect()
        self.pivots = np.array([x["v"] for x in rows], dtype=np.float64)
        self.gaps = np.sqrt(_squared(self.pivots, self.pivots))
        # Cells near each other follow each other, so that groups of them can be ruled out.
        self.order = np.argsort(self.gaps[0], kind="stable") if count and len(rows) else np.arange(0)

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""
        pivots = self.pivots

        def find(batch: pd.DataFrame) -> list:
            d = _squared(_matrix(batch["v"]), pivots)
            at = d.argmin(1)
            return [{"cell": int(c), "reach": float(np.sqrt(d[r, c]))} for r, c in enumerate(at)]

        out = _add_column(rows, "_c", "struct<cell: int, reach: double>", find)
        return out.select("*", "_c.cell", "_c.reach").drop("_c")

    def near(self, rows: DataFrame) -> DataFrame:
        """Every row once for each of a few cells with the nearest pivots, as ``cell``."""
        pivots, count = self.pivots, max(1, min(NEAR_CELLS, len(self.pivots) // 8))

        def find(batch: pd.DataFrame) -> list:
            d = _squared(_matrix(batch["v"]), pivots)
            return list(np.argsort(d, axis=1, kind="stable")[:, :count].astype(np.int32))

        out = _add_column(rows, "_c", "array<int>", find)
        return out.withColumn("cell", F.explode("_c")).drop("_c")


def _summary(assigned: DataFrame, cells: int, *extra: Column) -> pd.DataFrame:
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far"), *extra)
    return stats.toPandas().set_index("cell").reindex(range(cells))


def _blocks_of(n: pd.Series, block_rows: int) -> np.ndarray:
    return np.maximum(np.ceil(n.fillna(0).to_numpy() / block_rows), 1).astype(int)


def _groups(n: pd.Series, blocks: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int]]:
    """(cell, block, group): blocks in the order of their cells, gathered up to a number of rows."""
    rows = n.fillna(0).to_numpy()
    limit = max(min(GROUP_ROWS, rows.sum() / MIN_GROUPS), 1)
    out, group, held = [], 0, 0.0
    for cell in order:
        for block in range(blocks[cell]):
            size = rows[cell] / blocks[cell]
            if held and held + size > limit:
                group, held = group + 1, 0.0
            out.append((int(cell), block, group))
            held += size
    return out


def _block_pairs(
    queries: DataFrame,
    points: DataFrame,
    wanted: list[tuple[int, int]],
    query_blocks: tuple[pd.Series, np.ndarray],
    point_blocks: tuple[pd.Series, np.ndarray],
    order: np.ndarray,
    task: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``task`` on every wanted pair of (query cell, points by id with their matrix).

    Hot cells are spread over their blocks by id, and blocks gathered in groups, which are what is moved.
    """
    spark = queries.sparkSession
    q_of, p_of = (_groups(n, blocks, order) for n, blocks in (query_blocks, point_blocks))
    others = {i: np.array([j for k, j in wanted if k == i]) for i in {i for i, _ in wanted}}
    q_cell, p_cell = ({c: {g for d, _, g in of if d == c} for c, _, _ in of} for of in (q_of, p_of))
    pairs = sorted({(a, b) for i, j in wanted for a in q_cell[i] for b in p_cell[j]})

    def placed(rows: DataFrame, blocks: np.ndarray, of: list, own: str, other: str, sent: dict[int, list[int]]) -> DataFrame:
        """Rows with their group, once for each group of the other side."""
        table = [(c, int(blocks[c]), b, g, sent[g]) for c, b, g in of if g in sent]
        table = spark.createDataFrame(table, f"_cell int, _blocks int, _block int, {own} int, _sent array<int>")
        salt = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
        found = rows.join(F.broadcast(table), (F.col("cell") == F.col("_cell")) & (salt == F.col("_block")))
        return found.withColumn(other, F.explode("_sent")).drop("_cell", "_blocks", "_block", "_sent")

    to_points: dict[int, list[int]] = {}
    to_queries: dict[int, list[int]] = {}
    for a, b in pairs:
        to_points.setdefault(a, []).append(b)
        to_queries.setdefault(b, []).append(a)
    q = placed(queries, query_blocks[1], q_of, "qg", "pg", to_points)
    p = placed(points, point_blocks[1], p_of, "pg", "qg", to_queries)
    # Fresh column identities: both sides may come from the same table.
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns])

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("p_")).sort_values("id")
        if not len(left) or not len(right):
            return task(left, right, np.empty((0, 0)))
        b, cells = _matrix(right["v"]), right["cell"].to_numpy()
        parts = []
        for cell, some in left.groupby("cell"):
            use = np.isin(cells, others.get(int(cell), []))
            parts.append(task(some, right, b) if use.all() else task(some, right[use], b[use]))
        return pd.concat(parts)

    return q.groupBy("qg", "pg").cogroup(p.groupBy("p_qg", "p_pg")).applyInPandas(work, schema)


def _tile(points: int) -> int:
    """Queries whose distances to so many points are held at once."""
    return max(1, TILE // points)


def nearest(queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, place, other, distance): the ``k`` nearest points of every query, squared distances.

    Exact. ``queries`` and ``points`` are (id bigint, v array<double>). Equal distances are
    ordered by point id; ``place`` starts at 0. What a query finds in its own cell is a limit for
    what it needs of all others.
    """
    total = points.count()
    cells = _Cells(points, total)
    p, q = materialise(cells.assign(points)), materialise(cells.assign(queries))
    count = len(cells.pivots)
    # The k smallest reaches of each cell bound the k-th distance of any query from above.
    small = Window.partitionBy("cell").orderBy("reach")
    close = p.select("cell", "reach").withColumn("_r", F.row_number().over(small)).filter(F.col("_r") <= k)
    close_by_cell = close.groupBy("cell").agg(F.collect_list("reach").alias("close")).toPandas()
    close_by_cell = dict(zip(close_by_cell["cell"], close_by_cell["close"]))
    ps, qs = _summary(p, count), _summary(q, count)
    wanted = []
    for i in range(count):
        if not qs["n"].fillna(0)[i]:
            continue
        out = cells.gaps[i] + qs["far"][i]
        bounds = np.sort(np.concatenate([out[j] + np.array(r) for j, r in close_by_cell.items()]))
        limit = bounds[k - 1] + _SLACK if len(bounds) >= k else np.inf
        for j in range(count):
            if ps["n"].fillna(0)[j] and cells.gaps[i, j] - qs["far"][i] - ps["far"][j] <= limit:
                wanted.append((i, j))

    def first(row: np.ndarray, at: np.ndarray, d: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
        """The first ``keep`` of each row by distance, equal ones by id."""
        by_distance = np.lexsort((at, d, row))
        row, at, d = row[by_distance], at[by_distance], d[by_distance]
        some = np.arange(len(row)) - np.searchsorted(row, row) < keep
        return row[some], at[some], d[some]

    def task(left: pd.DataFrame, right: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64"})
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        vectors, keep, step = _matrix(left["v"]), min(k, len(others)), _tile(len(others))
        limit = left["limit"].to_numpy(dtype=np.float64) if "limit" in left else np.full(len(left), np.nan)
        known = np.flatnonzero(np.isfinite(limit))
        parts = []
        # The first of all parts given are the first of all, as each part keeps as many.
        for row, at, d in _screened(vectors[known], b, limit[known]) if len(known) else ():
            row, at, d = first(row, at, d, keep)
            parts.append((ids[known[row]], others[at], d))
        unknown = np.flatnonzero(~np.isfinite(limit))
        for start in range(0, len(unknown), step):
            some = unknown[start : start + step]
            d = _squared(vectors[some], b)
            # All within the k-th distance, then the first k of them.
            row, at = np.nonzero(~(d > np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep]))
            apart = vectors[some[row]] - b[at]
            row, at, d = first(row, at, np.einsum("ij,ij->i", apart, apart), keep)
            parts.append((ids[some[row]], others[at], d))
        columns = zip(*parts) if parts else ([np.empty(0, ids.dtype)], [np.empty(0, others.dtype)], [np.empty(0)])
        return pd.DataFrame(dict(zip(("id", "other", "distance"), map(np.concatenate, columns))))

    def run(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        return _block_pairs(
            rows.drop("reach"), p.drop("reach"), pairs, (qs["n"], _blocks_of(qs["n"], block_rows)),
            (ps["n"], _blocks_of(ps["n"], block_rows)), cells.order, task, "id bigint, other bigint, distance double",
        )

    own = [(i, j) for i, j in wanted if i == j]
    if len(own) < len(wanted):
        limits = run(q, own).groupBy("id").agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("limit"))
        q = q.join(limits, "id", "left")
    near = run(q, wanted)
    best = Window.partitionBy("id").orderBy("distance", "other")
    out = near.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < k)
    return out.select("id", "place", "other", "distance")


def manifold_radii(
    points: DataFrame, k: int = 3, clamp_percentile: float | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, radius): squared distance to the k-th neighbour, the point itself being rank 0.

    Radii above ``clamp_percentile`` become 0.
    """
    near = nearest(points, points, k + 1, block_rows)
    radii = near.filter(F.col("place") == k).select("id", F.col("distance").alias("radius"))
    if clamp_percentile is None:
        return radii
    from tesserae.operators.quantiles import exact_percentiles
    from tesserae.session import materialise

    radii = materialise(radii)
    top = exact_percentiles(radii, "radius", [clamp_percentile / 100.0]).first()["value"]
    return radii.withColumn("radius", F.when(F.col("radius") > top, 0.0).otherwise(F.col("radius")))


def in_manifold(
    queries: DataFrame, points: DataFrame, radii: DataFrame, block_rows: int = BLOCK_ROWS, only_inside: bool = False
) -> DataFrame:
    """(id, inside, realism, nearest) of every query against balls around the points.

    ``inside``: some point is within its radius. ``realism``: largest radius over distance.
    ``nearest``: closest point, the lowest id among equals. With ``only_inside`` just (id, inside).

    A query first looks into the cells nearest to it. What it finds there is a limit for what
    it needs of all points; if only ``inside`` is asked for, one that found a ball is done.
    """
    total = points.count()
    cells = _Cells(points, total)
    # Stored, as the radii are work of their own and used several times.
    p = materialise(cells.assign(points.join(radii, "id")))
    q = materialise(cells.assign(queries))
    count = len(cells.pivots)
    best = F.max_by("reach", "radius").alias("best_reach")
    ps = _summary(p, count, F.max("radius").alias("ball"), best, F.min("reach").alias("near"))
    there = [j for j in range(count) if ps["n"].fillna(0)[j]]

    def task(left: pd.DataFrame, right: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        empty = {"id": [], "inside": [], "realism": [], "distance": [], "other": []}
        if not len(left) or not len(right):
            return pd.DataFrame(empty).astype({"id": "int64", "other": "int64", "inside": "bool"})
        ids, others, ball = left["id"].to_numpy(), right["id"].to_numpy(), right["radius"].to_numpy()
        vectors = _matrix(left["v"])

        def likely() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Three points of each query with their distances: the nearest, the one of the best score, the one deepest in its ball."""
            for low in range(0, len(vectors), _tile(len(b))):
                some = vectors[low : low + _tile(len(b))]
                d = _squared(some, b)
                at = np.stack([d.argmin(1), (ball / (d + REALISM_EPS)).argmax(1), (ball - d).argmax(1)], axis=1).ravel()
                row = np.repeat(np.arange(len(some)), 3)
                apart = some[row] - b[at]
                yield low + row, at, np.einsum("ij,ij->i", apart, apart)

        if "limit" in left:
            limit = left["limit"].to_numpy(dtype=np.float64)
            limit = np.maximum(limit, left["share"].to_numpy(dtype=np.float64) * np.max(ball))
            pairs = _screened(vectors, b, np.where(np.isnan(limit), np.inf, limit))
        else:
            pairs = likely()
        parts = []
        for row, at, d in pairs:
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
            if not len(start):
                continue
            # The nearest of each row, the lowest id among equals.
            closest = np.lexsort((at, d, row))[start]
            parts.append(
                pd.DataFrame(
                    {
                        "id": ids[row[start]],
                        "inside": np.logical_or.reduceat(d <= ball[at], start),
                        "realism": np.maximum.reduceat(ball[at] / (d + REALISM_EPS), start),
                        "distance": d[closest],
                        "other": others[at[closest]],
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame(empty).astype({"id": "int64", "other": "int64", "inside": "bool"})

    def run(rows: DataFrame, sums: pd.DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        return _block_pairs(
            rows.drop("reach"), p.drop("reach"), pairs, (sums["n"], _blocks_of(sums["n"], block_rows)),
            (ps["n"], _blocks_of(ps["n"], block_rows)), cells.order, task,
            "id bigint, inside boolean, realism double, distance double, other bigint",
        )

    around = cells.near(q.drop("cell", "reach"))
    counts = around.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("cell").reindex(range(count))
    found = materialise(run(around, counts, [(j, j) for j in there if counts["n"].fillna(0)[j]]))
    known = found.groupBy("id").agg(
        F.max("inside").alias("inside"), F.max("realism").alias("_realism"), F.min("distance").alias("limit")
    )
    if only_inside:
        q = q.join(known.filter("inside").select("id"), "id", "left_anti").withColumn("limit", F.lit(0.0)).withColumn("share", F.lit(1.0))
    else:
        # A ball counts if its radius over the distance is larger than what is known, or if it may be the first that holds the query.
        share = F.when(F.col("_realism") > 0, 1 / F.col("_realism"))
        share = F.when(F.col("inside"), share).otherwise(F.greatest(share, F.lit(1.0)))
        share = F.when(F.col("_realism") > 0, share * (1 + _SLACK))
        q = q.join(known.select("id", "limit", share.alias("share")), "id", "left")
    q = materialise(q)
    qs = _summary(q, count)
    wanted = []
    for i in range(count):
        if not qs["n"].fillna(0)[i]:
            continue
        upper = {j: cells.gaps[i, j] + qs["far"][i] for j in there}
        closest = min(upper[j] + ps["near"][j] for j in there) + _SLACK
        realism = max(ps["ball"][j] / ((upper[j] + ps["best_reach"][j]) ** 2 + REALISM_EPS) for j in there)
        for j in there:
            low = max(cells.gaps[i, j] - qs["far"][i] - ps["far"][j] - _SLACK, 0.0)
            may_hold = low * low <= ps["ball"][j]
            may_top = ps["ball"][j] / (low * low + REALISM_EPS) >= realism * (1 - _SLACK)
            if may_hold or (not only_inside and (low <= closest or may_top)):
                wanted.append((i, j))
    part = found.unionByName(run(q, qs, wanted)) if wanted else found
    if only_inside:
        every = q.select("id", F.lit(False).alias("inside")).unionByName(part.select("id", "inside"))
        return every.groupBy("id").agg(F.max("inside").alias("inside"))
    return part.groupBy("id").agg(
        F.max("inside").alias("inside"),
        F.max("realism").alias("realism"),
        F.min_by("other", F.struct("distance", "other")).alias("nearest"),
    )


def precision_recall(
    real: DataFrame, fake: DataFrame, k: int = 3, clamp_percentile: float | None = None
) -> DataFrame:
    """(precision, recall): share of fakes inside the real manifold, and the reverse."""
    inside = F.avg(F.col("inside").cast("int"))
    p = in_manifold(fake, real, manifold_radii(real, k, clamp_percentile), only_inside=True).agg(inside.alias("v"))
    r = in_manifold(real, fake, manifold_radii(fake, k, clamp_percentile), only_inside=True).agg(inside.alias("v"))
    both = p.select(F.lit("precision").alias("k"), "v").unionByName(r.select(F.lit("recall").alias("k"), "v"))
    return both.agg(
        F.max(F.when(F.col("k") == "precision", F.col("v"))).alias("precision"),
        F.max(F.when(F.col("k") == "recall", F.col("v"))).alias("recall"),
    )
