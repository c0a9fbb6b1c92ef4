"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.core import rounded
from tesserae.operators import detection as det
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, view
from tesserae.plans.views import Tables

view(
    "best_dets",
    """SELECT * FROM (SELECT det_id, image_id, category_id, px AS x, y, w, h, score,
         row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) - 1 AS det_rank FROM boxes)
       WHERE det_rank < 100""",
    "boxes",
)
view(
    "ious",
    """SELECT image_id, category_id, det_id, det_rank, gt_id, gw * gh AS gt_area, inter / (dw * dh + gw * gh - inter) AS iou FROM (
         SELECT d.image_id, d.category_id, d.det_id, d.det_rank, g.det_id AS gt_id, d.w AS dw, d.h AS dh, g.w AS gw, g.h AS gh,
           greatest(least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x), 0)::DOUBLE
             * greatest(least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y), 0) AS inter
         FROM best_dets d JOIN boxes g ON g.image_id = d.image_id AND g.category_id = d.category_id)
       WHERE inter / (dw * dh + gw * gh - inter) >= 0.5""",
    "best_dets",
)


@query(
    "a18_annotations",
    """SELECT det_id AS annotation_id, image_id, category_id, w * h AS area FROM boxes""",
    "boxes",
)
def _(t: Tables):
    out = det.annotations(t.boxes, ["category_id", "x", "y", "w", "h", "score", "price"])
    return out.select("annotation_id", "image_id", "category_id", "area")


@query("a18_categories", "SELECT DISTINCT category_id, category_id::VARCHAR AS name FROM boxes", "boxes")
def _(t: Tables):
    return det.categories(t.boxes)


@query(
    "j11_known_images",
    """SELECT image_id, category_id, px, y, w, h, score FROM boxes
       WHERE image_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "boxes",
)
def _(t: Tables):
    truth = t.table("lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("image_id"))
    rows = det.in_truth(t.boxes, truth)
    return rows.select("image_id", "category_id", "px", "y", "w", "h", "score")


@query(
    "j13_box_overlaps",
    f"SELECT image_id, category_id, det_id, gt_id, {r('iou')} AS iou FROM ious",
    "ious",
)
def _(t: Tables):
    pairs = det.overlaps(det.best_detections(t.detections), t.truth_boxes)
    return pairs.select("image_id", "category_id", "det_id", "gt_id", rounded("iou").alias("iou"))


def _greedy(low: int, high: int) -> str:
    """Greedy matching, one detection rank per recursion step, for boxes of some areas."""
    return f"""WITH RECURSIVE th AS (SELECT k / 20.0::DOUBLE AS t FROM (SELECT unnest(range(10, 20)) AS k)),
   g AS (SELECT image_id, category_id, t, 0::BIGINT AS k, []::BIGINT[] AS used, -1::BIGINT AS det_id, 0 AS hit
         FROM (SELECT DISTINCT image_id, category_id FROM best_dets), th
     UNION ALL
     SELECT image_id, category_id, t, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.b) END, det_id,
       CASE WHEN pick IS NULL THEN 0 WHEN pick.inside THEN 1 ELSE -1 END FROM (
         SELECT g.image_id, g.category_id, g.t, g.k + 1 AS k, d.det_id, any_value(g.used) AS used,
           max({{'inside': i.gt_area BETWEEN {low} AND {high}, 'a': i.iou, 'b': i.gt_id}}) FILTER (i.gt_id IS NOT NULL) AS pick
         FROM g JOIN best_dets d ON d.image_id = g.image_id AND d.category_id = g.category_id AND d.det_rank = g.k
         LEFT JOIN ious i ON i.det_id = d.det_id AND i.iou >= g.t AND NOT list_contains(g.used, i.gt_id)
         GROUP BY g.image_id, g.category_id, g.t, g.k, d.det_id)),
   npos AS (SELECT category_id, count(*) AS boxes FROM boxes WHERE w * h BETWEEN {low} AND {high} GROUP BY category_id),
   c AS (SELECT g.category_id, g.t, g.hit = 1 AS tp, sum((g.hit = 1)::INT) OVER o AS tps, row_number() OVER o AS rank
         FROM g JOIN best_dets d USING (det_id)
         WHERE g.det_id >= 0 AND (g.hit = 1 OR (g.hit = 0 AND d.w * d.h BETWEEN {low} AND {high}))
         WINDOW o AS (PARTITION BY g.category_id, g.t ORDER BY d.score DESC, g.image_id, g.det_id)),
   pr AS (SELECT category_id, t AS threshold, rank, tps::BIGINT AS tp, tps / boxes AS recall, tps / rank AS precision
          FROM c JOIN npos USING (category_id) WHERE tp)
"""


_RAW_AP = """SELECT category_id, threshold, avg(p) AS ap, max(top) AS max_recall FROM (
    SELECT n.category_id, th.t AS threshold, l.level, coalesce(max(pr.precision), 0) AS p, coalesce(max(pr.recall), 0) AS top
    FROM npos n, th, (SELECT unnest(range(101)) * 0.01::DOUBLE AS level) l LEFT JOIN pr
      ON pr.category_id = n.category_id AND pr.threshold = th.t AND pr.recall >= l.level
    GROUP BY n.category_id, th.t, l.level) GROUP BY category_id, threshold"""
_AP = f"SELECT category_id, threshold, {r('ap')} AS ap, {r('max_recall')} AS max_recall FROM ({_RAW_AP})"
_GREEDY = _greedy(0, 10**10)


@query(
    "a17_precision_points",
    _GREEDY + f"SELECT category_id, threshold, rank, tp, {r('recall')} AS recall, {r('precision')} AS precision FROM pr",
    "ious",
)
def _(t: Tables):
    best = det.best_detections(t.detections)
    matched = det.matches(det.overlaps(best, t.truth_boxes))
    out = det.precision_points(best, matched, t.truth_boxes)
    return out.withColumn("recall", rounded("recall")).withColumn("precision", rounded("precision"))


def _scores(t: Tables, area: str):
    out = det.evaluate(t.detections, t.truth_boxes, area=area)
    return out.withColumn("ap", rounded("ap")).withColumn("max_recall", rounded("max_recall"))


@query("a17_average_precision", _GREEDY + _AP, "ious")
def _(t: Tables):
    return _scores(t, "all")


@query("a17_small_boxes", _greedy(0, 1024) + _AP, "ious")
def _(t: Tables):
    return _scores(t, "small")


@query("a17_medium_boxes", _greedy(1024, 9216) + _AP, "ious")
def _(t: Tables):
    return _scores(t, "medium")


def _means(low: int, high: int, limit: int, names: dict[str, str]) -> str:
    """Means over categories and thresholds: -1 when no category has a box of these areas."""
    greedy = _greedy(low, high).replace("WHERE g.det_id >= 0 AND", f"WHERE g.det_id >= 0 AND d.det_rank < {limit} AND")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {what} AS value FROM s" for n, what in names.items())
    return f"""SELECT name, {r("coalesce(value, -1.0)")} AS value FROM ({greedy}, s AS ({_RAW_AP}) {rows})"""


_WHOLE = {"ap": "avg(ap)", "ap50": "avg(ap) FILTER (threshold = 0.5)", "ap75": "avg(ap) FILTER (threshold = 0.75)"}


@query(
    "a17_summary",
    " UNION ALL ".join(
        [
            _means(0, 10**10, 100, _WHOLE | {"ar100": "avg(max_recall)"}),
            *[_means(0, 10**10, k, {f"ar{k}": "avg(max_recall)"}) for k in (1, 10)],
            *[
                _means(low, high, 100, {f"ap_{area}": "avg(ap)", f"ar_{area}": "avg(max_recall)"})
                for area, low, high in (("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**10))
            ],
        ]
    ),
    "ious",
)
def _(t: Tables):
    return det.full_summary(t.detections, t.truth_boxes).withColumn("value", rounded("value"))
