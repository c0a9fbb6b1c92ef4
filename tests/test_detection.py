"""Detection scores against a plain re-computation on a fixture with one crowded image."""

import random

import pytest

from tesserae.operators import detection as det


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(8)
    truth, found = [], []
    for n in range(160):
        # Half of all boxes crowd into one image and category.
        image, cat = (1, 0) if n % 2 else (rng.randrange(2, 12), rng.randrange(2))
        x, y, w, h = (rng.randrange(40), rng.randrange(40), rng.randrange(10, 30), rng.randrange(10, 30))
        truth.append((n, image, cat, x, y, w, h))
        found.append((n, image, cat, x + rng.randrange(-4, 5), y + rng.randrange(-4, 5), w, h, rng.randrange(20) / 20))
    found.append((999, 77, 0, 0, 0, 5, 5, 0.9))
    cols = "det_id bigint, image_id bigint, category_id bigint, x bigint, y bigint, w bigint, h bigint"
    return truth, found, spark.createDataFrame(truth, cols), spark.createDataFrame(found, cols + ", score double")


def plain(truth, found, limit):
    images = {g[1] for g in truth}
    scores = {}
    for cat in {g[2] for g in truth}:
        for t in det.THRESHOLDS:
            hits = []
            for image in images:
                gts = sorted(g for g in truth if g[1] == image and g[2] == cat)
                dets = sorted((d for d in found if d[1] == image and d[2] == cat), key=lambda d: (-d[7], d[0]))[:limit]
                free = {g[0]: g for g in gts}
                for d in dets:
                    best = max(((iou(d[3:7], g[3:7]), i) for i, g in free.items() if iou(d[3:7], g[3:7]) >= t), default=None)
                    if best:
                        free.pop(best[1])
                    hits.append((-d[7], image, d[0], bool(best)))
            hits.sort()
            total = sum(1 for g in truth if g[2] == cat)
            tp, points = 0, []
            for rank, (*_, hit) in enumerate(hits, 1):
                tp += hit
                points.append((tp / total, tp / rank))
            levels = [max((p for r, p in points if r >= i * 0.01), default=0.0) for i in range(101)]
            scores[(cat, t)] = (sum(levels) / 101, max((r for r, _ in points), default=0.0))
    return scores


@pytest.mark.parametrize("limit", [100, 10])
def test_average_precision(boxes, limit):
    truth, found, truth_df, found_df = boxes
    got = {(r["category_id"], r["threshold"]): r for r in det.evaluate(found_df, truth_df, limit=limit).collect()}
    want = plain(truth, found, limit)
    assert set(got) == set(want)
    for key, (ap, recall) in want.items():
        assert got[key]["ap"] == pytest.approx(ap, abs=1e-12)
        assert got[key]["max_recall"] == pytest.approx(recall, abs=1e-12)


def test_perfect_detections_score_one(boxes):
    from pyspark.sql import functions as F

    _, _, truth_df, _ = boxes
    same = truth_df.withColumn("score", F.lit(0.5))
    row = det.summary(det.evaluate(same, truth_df)).first()
    assert row["ap50"] == pytest.approx(1.0) and row["ar"] == pytest.approx(1.0)


def test_twelve_numbers(boxes):
    _, _, truth_df, found_df = boxes
    got = {r["name"]: r["value"] for r in det.full_summary(found_df, truth_df).collect()}
    assert len(got) == 12
    assert got["ap_large"] == got["ar_large"] == -1.0
    assert got["ar1"] <= got["ar10"] <= got["ar100"] and got["ap"] <= got["ap50"]


def test_box_format(spark):
    cols = "det_id bigint, image_id bigint, category_id bigint, x bigint, y bigint, w bigint, h bigint, det_rank bigint"
    a = spark.createDataFrame([(1, 1, 0, 10, 10, 10, 10, 0)], cols)
    b = spark.createDataFrame([(1, 1, 0, 10, 10, 20, 20, 0)], cols)
    assert det.overlaps(a, b, 0.0).first()["iou"] == pytest.approx(100 / 400)
    assert det.overlaps(a, b, 0.0, "centre").first()["iou"] == pytest.approx(100 / 400)
    shifted = spark.createDataFrame([(1, 1, 0, 15, 15, 10, 10, 0)], cols)
    assert det.overlaps(shifted, b, 0.0, "centre").first()["iou"] == pytest.approx(100 / 400)
    assert det.overlaps(a, shifted, 0.0).first()["iou"] == pytest.approx(25 / 175)
    with pytest.raises(ValueError):
        det.overlaps(a, b, 0.0, "other")


@pytest.mark.parametrize("limit", [1, 2, 100])
def test_boxes_outside_the_area_are_kept_for_strict_thresholds(spark, limit):
    cols = "image_id bigint, category_id bigint, det_id bigint, det_rank bigint, gt_id bigint, gt_area double, iou double"
    rows = [(1, 0, 7, 0, 1, 100.0, 0.60), (1, 0, 7, 0, 2, 100.0, 0.55), (1, 0, 7, 0, 3, 5000.0, 0.90)]
    got = det.matches(spark.createDataFrame(rows, cols), (0.5, 0.75), limit, "small").collect()
    assert [(r["det_id"], list(r["hit"])) for r in got] == [(7, [1, -1])]


def plain_states(pairs, threshold, area):
    """States of one (image, category): 1 for a box inside the area, -1 for one outside, 0 for none."""
    low, high = det.AREAS[area]
    used, out = set(), {}
    for d in sorted({p[3] for p in pairs}):
        own = [p for p in pairs if p[3] == d]
        out[own[0][2]] = 0
        free = [(low <= p[5] <= high, p[6], p[4]) for p in own if p[6] >= threshold and p[4] not in used]
        if free:
            inside, _, box = max(free)
            used.add(box)
            out[own[0][2]] = 1 if inside else -1
    return out


@pytest.mark.parametrize("area", ["all", "small"])
def test_groups_over_many_batches(spark, area):
    """Groups of one pair and of thousands, in batches of seven rows: the same states as one at a time."""
    rng = random.Random(5)
    groups = {}
    for image in range(40):
        dets, boxes = (60, 40) if image == 17 else (rng.randrange(1, 4), rng.randrange(1, 4))
        groups[image] = [
            (image, 0, image * 100 + d, d, image * 100 + g, rng.choice([100.0, 5000.0]), rng.randrange(10, 20) / 20)
            for d in range(dets)
            for g in range(boxes)
        ]
    for rows in groups.values():
        sizes = {p[4]: p[5] for p in rows}
        rows[:] = [(*p[:5], sizes[p[4]], p[6]) for p in rows]
    cols = "image_id bigint, category_id bigint, det_id bigint, det_rank bigint, gt_id bigint, gt_area double, iou double"
    pairs = spark.createDataFrame([p for rows in groups.values() for p in rows], cols)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["det_id"]: list(r["hit"]) for r in det.matches(pairs, area=area).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, t in enumerate(det.THRESHOLDS):
        want = {d: s for rows in groups.values() for d, s in plain_states(rows, t, area).items()}
        assert {d: hit[i] for d, hit in got.items()} == want


def test_no_pairs_and_too_many_thresholds(spark):
    cols = "image_id bigint, category_id bigint, det_id bigint, det_rank bigint, gt_id bigint, gt_area double, iou double"
    empty = spark.createDataFrame([], cols)
    assert det.matches(empty).count() == 0
    with pytest.raises(ValueError):
        det.matches(empty, tuple(k / 100 for k in range(63)))


def test_points_are_not_moved_by_category(spark):
    """Three categories would bring all points into three tasks."""
    rows = [(i, i // 4, i % 3, 10 * (i % 4), 0, 8, 8, i / 400) for i in range(400)]
    boxes = spark.createDataFrame(rows, "det_id bigint, image_id bigint, category_id bigint, x int, y int, w int, h int, score double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = det.best_detections(boxes)
        points = det.precision_points(best, det.matches(det.overlaps(best, boxes)), boxes)
        plan = points._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert points.count() == 10 * 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_summary_sorts_once_and_equals_its_parts(boxes, monkeypatch):
    """One range sort and one matching for all twelve numbers; small batches cut groups and blocks."""
    _, _, truth_df, found_df = boxes
    spark, parts, kind = truth_df.sparkSession, {}, type(truth_df)
    # Boxes of all three sizes, one of them just at a bound, and a category that is null.
    truth_df = truth_df.selectExpr("det_id", "image_id", "CASE WHEN det_id % 31 = 5 THEN NULL ELSE category_id END AS category_id", "x", "y",
                                   "CASE WHEN det_id % 3 = 0 THEN w * 6 WHEN det_id % 3 = 1 THEN 32 ELSE w END AS w", "CASE WHEN det_id % 3 = 0 THEN h * 5 WHEN det_id % 3 = 1 THEN 32 ELSE h END AS h")
    found_df = truth_df.join(found_df.select("det_id", "score"), "det_id").withColumn("x", truth_df["x"] + truth_df["det_id"] % 5)
    for limit, area, names in ((100, "all", ("ap", "ar100")), (10, "all", (None, "ar10")), (1, "all", (None, "ar1")), *((100, a, (f"ap_{a}", f"ar_{a}")) for a in ("small", "medium", "large"))):
        row = det.summary(det.evaluate(found_df, truth_df, limit=limit, area=area)).first()
        parts |= dict(zip(names, (row["ap"], row["ar"])))
    sorts, sort = [], kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: sorts.append(a) or sort(self, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["name"]: r["value"] for r in det.full_summary(found_df, truth_df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sorts) == 1 and got["ap_large"] > 0 and got["ap_small"] > 0
    parts.pop(None)
    assert {k: got[k] for k in parts} == pytest.approx(parts, abs=1e-12)
