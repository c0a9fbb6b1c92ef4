"""Whole images of different sizes against plain loops."""

import random

import numpy as np
import pytest

from tesserae.operators import grid, raster, segmentation as sg


def plain_boundary(labels, radius):
    """A pixel is inside when every pixel of its square exists and has its class."""
    height, width = labels.shape
    out = np.zeros_like(labels)
    for y in range(height):
        for x in range(width):
            square = [(y + j, x + i) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]
            calm = all(0 <= j < height and 0 <= i < width and labels[j, i] == labels[y, x] for j, i in square)
            out[y, x] = 0 if calm else labels[y, x] + 1
    return out


@pytest.mark.parametrize("shape", [(1, 1), (3, 20), (9, 9), (14, 11)])
@pytest.mark.parametrize("radius", [1, 2, 4])
def test_boundary(shape, radius):
    rng = np.random.default_rng(radius)
    coarse = rng.integers(0, 3, (-(-shape[0] // 5), -(-shape[1] // 5)))
    labels = np.kron(coarse, np.ones((5, 5), int))[: shape[0], : shape[1]]
    assert (raster.boundary(labels, radius) == plain_boundary(labels, radius)).all()


SHAPES = [(40, 50), (8, 8), (5, 33), (1, 7)]


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(3)
    rows = []
    for i, (h, w) in enumerate(SHAPES):
        gt = [(y // 6 + x // 9) % 4 for y in range(h) for x in range(w)]
        pred = [c if rng.random() < 0.9 else rng.randrange(4) for c in gt]
        rows.append((i, h, w, [rng.randrange(4) * 60 for _ in gt], gt, pred))
    rows += [(10, 0, 5, [], [], []), (11, None, None, None, None, None)]
    schema = "image_id bigint, height int, width int, gray array<bigint>, gt array<bigint>, pred array<bigint>"
    return rows, spark.createDataFrame(rows, schema)


def test_label_counts(images):
    rows, df = images
    got = {tuple(r)[:5]: r["n"] for r in raster.label_counts(df).collect()}
    want = {}
    for i, h, w, _, gt, pred in rows[: len(SHAPES)]:
        maps = [np.array(m).reshape(h, w) for m in (gt, pred)]
        radius = sg.boundary_radius(h, w)
        edges = [plain_boundary(m, radius) for m in maps]
        for key in zip(*[m.ravel().tolist() for m in maps + edges], strict=True):
            want[(i, *key)] = want.get((i, *key), 0) + 1
    assert {sg.boundary_radius(h, w) for h, w in SHAPES} == {1, 2}
    assert got == want


def test_remap_keeps_the_line_between_merged_classes(spark):
    labels = [0, 0, 0, 1, 1, 1] * 5
    df = spark.createDataFrame([(1, 5, 6, labels, labels)], "image_id int, height int, width int, gt array<int>, pred array<int>")
    match = spark.createDataFrame([(0, 7), (1, 7)], "source bigint, target bigint")
    counts = raster.remap_counts(raster.label_counts(df), match).collect()
    assert {r["pred"] for r in counts} == {7}
    on, off = (sum(r["n"] for r in counts if (r["b_pred"] == 8) is edge) for edge in (True, False))
    assert (on, off) == (24, 6)


def test_entropy_and_choice_equal_the_pixel_table(spark, images):
    rows, df = images
    for i, h, w, gray, *_ in rows[: len(SHAPES)]:
        pixels = spark.createDataFrame(
            [(i, p // w, p % w, g) for p, g in enumerate(gray)], "image_id bigint, y bigint, x bigint, gray bigint"
        )
        cells = grid.patch_entropy(pixels, [2, 4, 8], h, w)
        want = {tuple(r)[:4]: r["entropy"] for r in cells.select("image_id", "size", "cy", "cx", "entropy").collect()}
        one = df.filter(f"image_id = {i}")
        got = {tuple(r)[:4]: r["entropy"] for r in raster.cell_entropy(one, [2, 4, 8]).collect()}
        assert got == pytest.approx(want, abs=1e-9)
        limits = {4: 1.8, 8: 1.9}
        kept = grid.choose_cells(cells, limits).select("image_id", "size", "cy", "cx", "chosen")
        chosen = raster.choose_cells(one, limits, smallest=2).select("image_id", "size", "cy", "cx", "chosen")
        assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, kept.collect()))
