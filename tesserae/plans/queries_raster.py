"""Queries over images of different sizes, one row each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.core import rounded
from tesserae.operators import raster, segmentation as sg
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, view
from tesserae.plans.queries_grid import CLASSES
from tesserae.plans.views import Tables

view(
    "shaped",
    """SELECT image_id, 64 // width AS height, width, p // width AS y, p % width AS x,
         least(greatest(floor((v + 1) * 127.5), 0), 255)::BIGINT AS gray,
         CASE WHEN (image_id + p // width + p % width) % 50 = 0 THEN 1000
              ELSE least(greatest(floor((v + 0.3) * 6), 0), 3) END::BIGINT AS gt,
         least(greatest(floor((floor(v * 10 + 0.5) / 10 + 0.3) * 6), 0), 3)::BIGINT AS pred
       FROM (SELECT *, CASE image_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 16 END AS width FROM vec)""",
    "vec",
)
# All three shapes have a boundary radius of one pixel.
view(
    "shaped_edges",
    """SELECT image_id, gt, pred, b_gt, b_pred, count(*) AS n FROM (
         SELECT a.image_id, any_value(a.gt) AS gt, any_value(a.pred) AS pred,
           CASE WHEN count(*) FILTER (b.gt = a.gt) < 9 THEN any_value(a.gt) + 1 ELSE 0 END AS b_gt,
           CASE WHEN count(*) FILTER (b.pred = a.pred) < 9 THEN any_value(a.pred) + 1 ELSE 0 END AS b_pred
         FROM shaped a JOIN shaped b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
         GROUP BY a.image_id, a.y, a.x) GROUP BY ALL""",
    "shaped",
)
view(
    "shaped_entropies",
    """SELECT image_id, size, cy, cx, CASE WHEN (cy + 1) * size > any_value(height) OR (cx + 1) * size > any_value(width)
         THEN 1e6 ELSE sum(-(n / (size * size)) * log2(n / (size * size) + 1e-10)) END::DOUBLE AS entropy
       FROM (SELECT image_id, height, width, size, y // size AS cy, x // size AS cx, gray, count(*)::DOUBLE AS n
             FROM shaped, (VALUES (2), (3), (4), (8)) s(size) GROUP BY ALL) GROUP BY image_id, size, cy, cx""",
    "shaped",
)


@query("a16_image_boundaries", "SELECT image_id, gt, pred, b_gt, b_pred, n FROM shaped_edges", "shaped_edges")
def _(t: Tables):
    return raster.label_counts(t.images)


@query(
    "a16_image_boundary_iou",
    f"""SELECT {r("avg(tp / (t + p - tp + 1e-10) * 100)")} AS mbiou FROM (
          SELECT c.cls, coalesce(sum(n) FILTER (b_pred = c.cls), 0) AS t, coalesce(sum(n) FILTER (b_gt = c.cls), 0) AS p,
            coalesce(sum(n) FILTER (b_gt = c.cls AND b_pred = c.cls), 0) AS tp
          FROM (SELECT unnest(range(1, 7)) AS cls) c, (SELECT * FROM shaped_edges WHERE gt <> 1000) GROUP BY c.cls)""",
    "shaped_edges",
)
def _(t: Tables):
    rows = sg.scored_pixels(raster.label_counts(t.images))
    pairs = rows.select((F.col("b_gt") - 1).alias("gt"), (F.col("b_pred") - 1).alias("pred"), "n")
    return sg.class_iou(pairs, CLASSES).agg(rounded(F.avg("iou")).alias("mbiou"))


@query(
    "j12_boundary_remap",
    """SELECT image_id, gt, to_class AS pred, b_gt, CASE WHEN b_pred = 0 THEN 0 ELSE to_class + 1 END AS b_pred,
         sum(n)::BIGINT AS n
       FROM (SELECT s.*, n_regionkey::BIGINT AS to_class FROM shaped_edges s LEFT JOIN nation ON n_nationkey = pred)
       GROUP BY ALL""",
    "shaped_edges",
)
def _(t: Tables):
    match = t.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("source"), F.col("n_regionkey").cast("bigint").alias("target")
    )
    return raster.remap_counts(raster.label_counts(t.images), match)


@query(
    "a22_image_entropy",
    f"SELECT image_id, size, cy, cx, {r('entropy')} AS entropy FROM shaped_entropies",
    "shaped_entropies",
)
def _(t: Tables):
    return raster.cell_entropy(t.images, [2, 3, 4, 8]).withColumn("entropy", rounded("entropy"))


@query(
    "q5_image_selection",
    """WITH k AS (SELECT *, entropy < CASE size WHEN 8 THEN 4.6 WHEN 4 THEN 3.6 END AS calm
                  FROM shaped_entropies WHERE size <> 3)
       SELECT a.image_id, a.size, a.cy, a.cx, (a.size = 2 OR a.calm) AND NOT EXISTS (SELECT 1 FROM k b
           WHERE b.image_id = a.image_id AND b.size > a.size AND b.calm AND b.cy = a.cy * a.size // b.size
             AND b.cx = a.cx * a.size // b.size) AS chosen FROM k a""",
    "shaped_entropies",
)
def _(t: Tables):
    return raster.choose_cells(t.images, {4: 3.6, 8: 4.6}, smallest=2)
