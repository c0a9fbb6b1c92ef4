"""Queries over pixels and label maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import core
from tesserae.functions.core import rounded
from tesserae.operators import grid, segmentation as sg
from tesserae.operators.quantiles import exact_percentiles
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, view
from tesserae.plans.views import IMAGE_SIDE, Tables

#: Classes 0..5 are scored; 4 and 5 never occur, like rare classes of a real label set.
CLASSES = 6

view(
    "entropies",
    """SELECT image_id, size, cy, cx, CASE WHEN (cy + 1) * size > 8 OR (cx + 1) * size > 8 THEN 1e6
         ELSE sum(-(n / (size * size)) * log2(n / (size * size) + 1e-10)) END::DOUBLE AS entropy
       FROM (SELECT image_id, size, y // size AS cy, x // size AS cx, gray * 2 AS bin, count(*)::DOUBLE AS n
             FROM pixels, (VALUES (2), (3), (4), (8)) s(size) GROUP BY ALL) GROUP BY image_id, size, cy, cx""",
    "pixels",
)
view("valid", "SELECT * FROM seg WHERE gt <> 1000", "seg")
view(
    "bmap",
    """SELECT a.image_id, a.y, a.x, any_value(a.gt) AS gt, any_value(a.pred) AS pred,
         CASE WHEN count(*) FILTER (b.gt = a.gt) < 9 THEN any_value(a.gt) + 1 ELSE 0 END AS b_gt,
         CASE WHEN count(*) FILTER (b.pred = a.pred) < 9 THEN any_value(a.pred) + 1 ELSE 0 END AS b_pred
       FROM seg a JOIN seg b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
       GROUP BY a.image_id, a.y, a.x""",
    "seg",
)


@query("a22_patch_entropy", f"SELECT image_id, size, cy, cx, {r('entropy')} AS entropy FROM entropies", "entropies")
def _(t: Tables):
    out = grid.patch_entropy(t.pixels, [2, 3, 4, 8], IMAGE_SIDE, IMAGE_SIDE)
    return out.withColumn("entropy", rounded("entropy"))



@query(
    "a20_entropy_distribution",
    f"""WITH e AS (SELECT {r("entropy")} AS entropy FROM entropies WHERE size = 4),
        s AS (SELECT avg(entropy) AS mean, stddev_pop(entropy) AS std, min(entropy) AS min, max(entropy) AS max,
          avg((entropy < 3.5)::INT) AS below, quantile_cont(entropy, 0.25) AS p25, quantile_cont(entropy, 0.5) AS p50,
          quantile_cont(entropy, 0.75) AS p75, quantile_cont(entropy, 0.9) AS p90, quantile_cont(entropy, 0.95) AS p95 FROM e)
        SELECT name, {r("value")} AS value FROM (UNPIVOT s ON mean, std, min, max, below, p25, p50, p75, p90, p95
          INTO NAME name VALUE value)""",
    "entropies",
)
def _(t: Tables):
    cells = grid.patch_entropy(t.pixels, [4], IMAGE_SIDE, IMAGE_SIDE).withColumn("entropy", rounded("entropy"))
    out = grid.distribution(cells, "entropy", [0.25, 0.5, 0.75, 0.9, 0.95], 3.5)
    return out.withColumn("value", rounded("value"))


_SHARES = (0.0, 0.01, 0.5, 0.99, 1.0)


@query(
    "a20_price_quantiles",
    " UNION ALL ".join(
        f"""SELECT {s}::DOUBLE AS share, {r(f"quantile_cont(l_extendedprice::DOUBLE, {s})")} AS value FROM lineitem"""
        for s in _SHARES
    ),
)
def _(t: Tables):
    """Exact quantiles of a whole column, straight from its files."""
    found = exact_percentiles(t.table("lineitem"), "l_extendedprice", _SHARES)
    return found.withColumn("value", rounded("value"))


@query(
    "q5_entropy_selection",
    """WITH k AS (SELECT *, entropy < CASE size WHEN 8 THEN 4.6 WHEN 4 THEN 3.6 END AS calm FROM entropies WHERE size <> 3)
       SELECT a.image_id, a.size, a.cy, a.cx, (a.size = 2 OR a.calm) AND NOT EXISTS (SELECT 1 FROM k b
           WHERE b.image_id = a.image_id AND b.size > a.size AND b.calm AND b.cy = a.cy * a.size // b.size
             AND b.cx = a.cx * a.size // b.size) AS chosen FROM k a""",
    "entropies",
)
def _(t: Tables):
    cells = grid.patch_entropy(t.pixels, [2, 4, 8], IMAGE_SIDE, IMAGE_SIDE)
    return grid.choose_cells(cells, {4: 3.6, 8: 4.6}).drop("entropy")


_PSNR = """SELECT image_id, -10 * log10(avg((re - fa) ** 2) + 1e-10) AS psnr, 10 * log10(1 / avg((re - fa) ** 2)) AS psnr_exact,
    20 * log10(255 / sqrt(avg((floor(re * 255) - floor(fa * 255)) ** 2))) AS psnr_8bit FROM pair GROUP BY image_id"""


@query(
    "a4_psnr",
    f"""SELECT image_id, {r("psnr", 4)} AS psnr, {r("psnr_exact", 4)} AS psnr_exact, {r("psnr_8bit", 4)} AS psnr_8bit
        FROM ({_PSNR})""",
    "pair",
)
def _(t: Tables):
    names = ["psnr", "psnr_exact", "psnr_8bit"]
    return grid.psnr(t.pairs).select("image_id", *[rounded(n, 4).alias(n) for n in names])


@query(
    "a4_mean_psnr",
    f"""SELECT {r("avg(psnr)", 4)} AS psnr, {r("avg(psnr_exact)", 4)} AS psnr_exact, {r("avg(psnr_8bit)", 4)} AS psnr_8bit
        FROM ({_PSNR})""",
    "pair",
)
def _(t: Tables):
    names = ["psnr", "psnr_exact", "psnr_8bit"]
    return grid.psnr(t.pairs).agg(*[rounded(F.avg(n), 4).alias(n) for n in names])


@query(
    "a5_patch_gain",
    f"""WITH m AS (SELECT image_id, (p // 8 // 2) * 4 + (p % 8) // 2 AS patch,
             avg((v - floor(v * 10 + 0.5) / 10) ** 2) AS b, avg((v - floor(v * 40 + 0.5) / 40) ** 2) AS t FROM vec GROUP BY 1, 2)
        SELECT image_id, patch, {r("10 * (log10(1 / (t + 1e-10)) - log10(1 / (b + 1e-10)))", 4)} AS gain FROM m""",
    "vec",
)
def _(t: Tables):
    v = F.col("v")
    pixels = t.pixels.select(
        "image_id", "y", "x", v.alias("real"), (F.floor(v * 10 + 0.5) / 10).alias("base"), (F.floor(v * 40 + 0.5) / 40).alias("test")
    )
    return grid.patch_gains(pixels, 4, 2).withColumn("gain", rounded("gain", 4))


_CONTRIB = """SELECT pos, p // 8 AS y, p % 8 AS x, avg(abs(d)) AS mean_abs, avg(d * d) AS mean_sq
    FROM (SELECT pos, p, (v - floor(v * 10 + 0.5) / 10) / (1 + abs(p // 8 - pos)) AS d
          FROM vec, (SELECT unnest(range(8)) AS pos)) GROUP BY pos, p"""


def _replaced(t: Tables):
    """Pixels after each of eight tokens was replaced; the effect fades with the distance."""
    v, pos = F.col("v"), F.col("pos")
    rows = t.pixels.select("y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    coarse = F.floor(v * 10 + 0.5) / 10
    changed = v - (v - coarse) / (1 + F.abs(F.col("y") - pos))
    return rows.select(pos.cast("bigint").alias("pos"), "y", "x", v.alias("base"), changed.alias("changed"))


@query(
    "a23_contribution_map",
    f"SELECT pos, y, x, {r('mean_abs')} AS mean_abs, {r('mean_sq')} AS mean_sq FROM ({_CONTRIB})",
    "vec",
)
def _(t: Tables):
    out = grid.contribution(_replaced(t))
    return out.withColumn("mean_abs", rounded("mean_abs")).withColumn("mean_sq", rounded("mean_sq"))


@query(
    "a23_contribution_by_position",
    f"""SELECT pos, {r("avg(mean_abs)")} AS mean_abs, {r("ln(avg(mean_abs))", 4)} AS log_abs,
          {r("avg(mean_sq)")} AS mean_sq, {r("ln(avg(mean_sq))", 4)} AS log_sq FROM ({_CONTRIB}) GROUP BY pos""",
    "vec",
)
def _(t: Tables):
    out = grid.contribution_by_position(grid.contribution(_replaced(t)))
    logs = [rounded(c, 4).alias(c) for c in ("log_abs", "log_sq")]
    return out.select("pos", rounded("mean_abs").alias("mean_abs"), rounded("mean_sq").alias("mean_sq"), *logs)


@query(
    "f9_class_channels",
    "SELECT gt, gt % 256 AS r, gt // 256 AS g, gt AS back, count(*) AS n FROM seg GROUP BY gt",
    "seg",
)
def _(t: Tables):
    red, green = core.class_to_rg("gt")
    rows = t.seg.groupBy("gt").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("gt", red.alias("r"), green.alias("g"), "n")
    return rows.withColumn("back", core.rg_to_class("r", "g"))


@query("p5_ignored_pixels", "SELECT image_id, y, x, gt, pred FROM valid", "valid")
def _(t: Tables):
    return sg.scored_pixels(t.seg)


@query(
    "j12_class_remap",
    """SELECT image_id, y, x, gt, n_regionkey::BIGINT AS pred FROM seg LEFT JOIN nation ON n_nationkey = pred""",
    "seg",
)
def _(t: Tables):
    match = t.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("source"), F.col("n_regionkey").cast("bigint").alias("target")
    )
    return sg.remap(t.seg, match)


_AREAS = """SELECT c.cls, count(*) FILTER (s.pred = c.cls) AS t, count(*) FILTER (s.gt = c.cls) AS p,
    count(*) FILTER (s.gt = c.cls AND s.pred = c.cls) AS tp
  FROM (SELECT unnest(range(6)) AS cls) c, {source} s GROUP BY c.cls"""


@query(
    "a12_class_iou",
    f"SELECT cls, t, p, tp, {r('tp / (t + p - tp + 1e-10) * 100')} AS iou FROM ({_AREAS.format(source='valid')})",
    "valid",
)
def _(t: Tables):
    out = sg.class_iou(sg.counts(sg.scored_pixels(t.seg)), CLASSES)
    return out.withColumn("iou", rounded("iou"))


@query(
    "a12_mean_iou",
    f"SELECT {r('avg(tp / (t + p - tp + 1e-10) * 100)')} AS miou FROM ({_AREAS.format(source='valid')})",
    "valid",
)
def _(t: Tables):
    out = sg.mean_iou(sg.class_iou(sg.counts(sg.scored_pixels(t.seg)), CLASSES))
    return out.withColumn("miou", rounded("miou"))


_BUCKETS = """WITH area AS (SELECT image_id, gt, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id) AS total
    FROM valid GROUP BY image_id, gt),
  sized AS (SELECT image_id, gt, CASE WHEN c <= 5 THEN 0 WHEN c <= 25 THEN 1 WHEN c <= 50 THEN 2 ELSE 3 END AS bucket
    FROM (SELECT *, ceil(100.0 * n / total) AS c FROM area WHERE gt <> 0)),
  tagged AS (SELECT v.*, s.bucket FROM {source} v JOIN sized s ON s.image_id = v.image_id AND s.gt = v.gt
    UNION ALL SELECT v.*, s.bucket FROM {source} v JOIN (SELECT DISTINCT image_id, bucket FROM sized) s
      ON s.image_id = v.image_id WHERE v.gt = 0)
"""


@query(
    "a13_iou_by_size",
    _BUCKETS.format(source="valid")
    + f"""SELECT every.bucket::BIGINT AS bucket, coalesce(miou, 0.0)::DOUBLE AS miou
        FROM (SELECT unnest(range(4)) AS bucket) every LEFT JOIN (
          SELECT bucket, {r("avg(tp / (t + p - tp + 1e-10)) * 100")} AS miou FROM (
          SELECT bucket, c.cls, count(*) FILTER (pred = c.cls) AS t, count(*) FILTER (gt = c.cls) AS p,
            count(*) FILTER (gt = c.cls AND pred = c.cls) AS tp FROM tagged, (SELECT unnest(range(6)) AS cls) c
          GROUP BY bucket, c.cls) WHERE p > 0 GROUP BY bucket) f ON f.bucket = every.bucket""",
    "valid",
)
def _(t: Tables):
    parts = sg.size_parts(sg.counts(sg.scored_pixels(t.seg), "image_id"))
    return sg.iou_by_size(parts, CLASSES).withColumn("miou", rounded("miou"))


@query(
    "a14_f_measure",
    f"""WITH a AS (SELECT image_id, count(*) FILTER (gt > 0)::DOUBLE AS t, count(*) FILTER (pred > 0)::DOUBLE AS p,
             count(*) FILTER (gt > 0 AND pred > 0)::DOUBLE AS tp FROM valid GROUP BY image_id),
        b AS (SELECT tp / (t + 1e-20) AS rec, tp / (p + 1e-20) AS prec FROM a)
        SELECT {r("avg(1.3 * prec * rec / (0.3 * prec + rec + 1e-20)) * 100")} AS f_measure FROM b""",
    "valid",
)
def _(t: Tables):
    per_image = sg.f_measures(sg.counts(sg.scored_pixels(t.seg), "image_id"))
    return per_image.agg(rounded(F.avg("f") * 100).alias("f_measure"))


@query(
    "a15_image_accuracy",
    f"""WITH a AS (SELECT image_id, c.cls, count(*) FILTER (pred = c.cls) AS t, count(*) FILTER (gt = c.cls) AS p
             FROM valid, (SELECT unnest(range(6)) AS cls) c GROUP BY image_id, c.cls),
        b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY t DESC, cls) AS rn FROM a WHERE cls > 0)
        SELECT {r("avg((t > 0 AND p > 0)::INT) * 100")} AS accuracy FROM b WHERE rn = 1""",
    "valid",
)
def _(t: Tables):
    hits = sg.image_hits(sg.counts(sg.scored_pixels(t.seg), "image_id"), CLASSES)
    return hits.agg(rounded(F.avg("hit") * 100).alias("accuracy"))


def _boundaries(t: Tables):
    radius = sg.boundary_radius(IMAGE_SIDE, IMAGE_SIDE)
    return sg.boundary_maps(t.seg, ["gt", "pred"], IMAGE_SIDE, IMAGE_SIDE, radius)


@query("a16_boundary_map", "SELECT * FROM bmap", "bmap")
def _(t: Tables):
    return _boundaries(t)


@query(
    "a16_boundary_iou",
    f"""SELECT {r("avg(tp / (t + p - tp + 1e-10) * 100)")} AS mbiou FROM (
          SELECT c.cls, count(*) FILTER (b_pred = c.cls) AS t, count(*) FILTER (b_gt = c.cls) AS p,
            count(*) FILTER (b_gt = c.cls AND b_pred = c.cls) AS tp
          FROM (SELECT unnest(range(1, 7)) AS cls) c, (SELECT * FROM bmap WHERE gt <> 1000) GROUP BY c.cls)""",
    "bmap",
)
def _(t: Tables):
    pairs = sg.boundary_counts(sg.scored_pixels(_boundaries(t)))
    out = sg.class_iou(pairs, CLASSES)
    return out.agg(rounded(F.avg("iou")).alias("mbiou"))


@query(
    "a16_boundary_iou_by_size",
    _BUCKETS.format(source="(SELECT * FROM bmap WHERE gt <> 1000)")
    + f"""SELECT bucket::BIGINT AS bucket, {r("avg(tp / (t + p - tp + 1e-10)) * 100")} AS miou FROM (
          SELECT bucket, c.cls, count(*) FILTER (b_pred = c.cls) AS t, count(*) FILTER (b_gt = c.cls) AS p,
            count(*) FILTER (b_gt = c.cls AND b_pred = c.cls) AS tp FROM tagged, (SELECT unnest(range(1, 7)) AS cls) c
          GROUP BY bucket, c.cls) WHERE p > 0 GROUP BY bucket""",
    "valid",
    "bmap",
)
def _(t: Tables):
    parts = sg.boundary_size_parts(sg.scored_pixels(_boundaries(t)))
    return sg.iou_by_size(parts, CLASSES).withColumn("miou", rounded("miou"))
