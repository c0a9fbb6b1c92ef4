import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import grid, neighbours as nb, quality


def table(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, v array<double>")


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 6
    a = np.concatenate([c + rng.normal(size=(40, 5)) for c in centres])
    # A third of all rows are copies of one vector.
    a = np.concatenate([a, np.repeat(a[:1], 120, axis=0)])
    b = np.concatenate([c + rng.normal(size=(20, 5)) for c in centres[:4]])
    return a, b


@pytest.fixture()
def many_cells(monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 25)


def distances(x, y):
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)


def test_nearest_is_exact_over_many_blocks(spark, clouds, many_cells):
    a, b = clouds
    rows = nb.nearest(table(spark, b), table(spark, a), 4, block_rows=30).collect()
    d = distances(b, a)
    assert len(rows) == len(b) * 4
    for r in rows:
        assert abs(r["distance"] - np.sort(d[r["id"]])[r["place"]]) < 1e-9
        assert abs(d[r["id"], r["other"]] - r["distance"]) < 1e-9


def test_radii_and_membership_are_exact(spark, clouds, many_cells):
    a, b = clouds
    real, fake = table(spark, a), table(spark, b)
    radii = nb.manifold_radii(real, 3, block_rows=30)
    want = np.sort(distances(a, a), axis=1)[:, 3]
    got = {r["id"]: r["radius"] for r in radii.collect()}
    assert np.allclose([got[i] for i in range(len(a))], want, atol=1e-9)
    out = {r["id"]: r for r in nb.in_manifold(fake, real, radii, block_rows=30).collect()}
    d = distances(b, a)
    for i in range(len(b)):
        assert out[i]["inside"] == bool((d[i] <= want).any())
        assert np.isclose(out[i]["realism"], (want / (d[i] + 1e-5)).max(), rtol=1e-6)
        assert np.isclose(d[i, out[i]["nearest"]], d[i].min())


def test_far_cells_are_ruled_out(spark, clouds, many_cells, monkeypatch):
    a, b = clouds
    seen = {}
    plain = nb._block_pairs

    def spy(q, p, wanted, *rest):
        seen["pairs"] = len(wanted)
        return plain(q, p, wanted, *rest)

    monkeypatch.setattr(nb, "_block_pairs", spy)
    nb.nearest(table(spark, b), table(spark, a), 1, block_rows=30).collect()
    cells = len(nb._Cells(table(spark, a), len(a)).pivots)
    assert cells > 4 and seen["pairs"] < cells * cells


def test_large_codebook_uses_the_blocked_join(spark, clouds, monkeypatch):
    a, b = clouds
    book = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], "code bigint, e array<double>")
    rows = table(spark, a, "image_id")
    small = {r["image_id"]: r["code"] for r in nb.nearest_code(rows, book, "v").collect()}
    monkeypatch.setattr(nb, "MAX_CODEBOOK", 10)
    large = {r["image_id"]: r["code"] for r in nb.nearest_code(rows, book, "v").collect()}
    assert small == large and len(small) == len(a)


def test_moments_match_numpy(spark, clouds):
    a, _ = clouds
    rows = quality.covariance(quality.moment_sums(table(spark, a).repartition(5), "v")).collect()
    got = np.zeros((5, 5))
    for r in rows:
        got[r["i"], r["j"]] = r["cov"]
    assert np.allclose(got, np.cov(a, rowvar=False))


def test_frechet_distance(spark, clouds):
    a, b = clouds
    x, y = table(spark, a), table(spark, b)
    assert abs(quality.frechet_distance(x, x)) < 1e-6
    assert quality.frechet_distance(x, y) == pytest.approx(quality.frechet_distance(y, x), rel=1e-6)
    moved = table(spark, a + 2.0)
    assert quality.frechet_distance(x, moved) == pytest.approx(4.0 * 5, rel=1e-5)
    with pytest.raises(ValueError):
        quality.frechet_distance(x.limit(0), x)


def test_exact_percentiles(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 50, 777)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["share"]: r["value"] for r in grid.exact_percentiles(df, "x", shares).collect()}
    assert np.allclose([got[s] for s in shares], np.percentile(values, [100 * s for s in shares]))


def test_equal_images_have_infinite_psnr(spark):
    df = spark.createDataFrame([([0.1, 0.5], [0.1, 0.5])], "real array<double>, fake array<double>")
    row = grid.psnr(df).first()
    assert row["psnr_exact"] == float("inf") and row["psnr_8bit"] == float("inf") and abs(row["psnr"] - 100) < 1e-9


def test_top_k_keeps_ties(spark):
    rows = [(1, c, p) for c, p in enumerate([0.3, 0.3, 0.2, 0.2])]
    df = spark.createDataFrame(rows, "image_id bigint, class bigint, p double")
    assert quality.top_k_top_p(df, 1, 1.0).count() == 2
    assert quality.top_k_top_p(df, 3, 1.0).count() == 4
    assert quality.top_k_top_p(df, 4, 0.5).agg(F.count("*")).first()[0] == 2


def test_large_codebook_with_repeated_text_keys(spark, clouds, monkeypatch):
    a, b = clouds
    book = spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(b)], "code bigint, e array<double>")
    rows = spark.createDataFrame([(f"k{i % 2}", [float(x) for x in v]) for i, v in enumerate(a)], "key string, v array<double>")
    weights = rows.select("key", nb.F.transform(nb.F.sequence(nb.F.lit(1), nb.F.lit(len(b))), lambda i: i / 7 + nb.F.get("v", nb.F.lit(0))).alias("w"))

    def results():
        near = nb.nearest_code(rows, book, "v", normalise=True, key="key").collect()
        products = nb.codebook_products(rows, book, "v", "p").collect()
        soft = nb.soft_entry(weights, book, "w").collect()
        return (
            sorted((r["key"], tuple(r["v"]), r["code"], round(r["distance"], 6)) for r in near),
            sorted((tuple(r["v"]), tuple(np.round(r["p"], 9))) for r in products),
            sorted(tuple(np.round(r["z"], 6)) for r in soft),
        )

    small = results()
    monkeypatch.setattr(nb, "MAX_CODEBOOK", 10)
    assert results() == small


def test_rows_are_sent_to_groups_not_to_cells(spark, monkeypatch):
    """Forty cells, a few groups: copies of a row do not grow with the number of cells."""
    import pandas as pd

    groups = nb._groups(pd.Series([10.0] * 40), np.ones(40, int), np.arange(40))
    assert len({g for _, _, g in groups}) == nb.MIN_GROUPS and len(groups) == 40
    monkeypatch.setattr(nb, "CELL_ROWS", 10)
    values = np.random.default_rng(3).integers(0, 4, (400, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id bigint, v array<double>")
    got = {(r["id"], r["place"]): r["other"] for r in nb.nearest(df, df, 3, block_rows=16).collect()}
    for i, v in enumerate(values):
        best = np.argsort(((values - v) ** 2).sum(1), kind="stable")[:3]
        assert [got[i, place] for place in range(3)] == best.tolist()


@pytest.mark.parametrize("spread", [1e-25, 1.0, 1e20])
def test_screened_pairs_hold_all_within_the_limit(monkeypatch, spread):
    monkeypatch.setattr(nb, "TILE", 1000)
    monkeypatch.setattr(nb, "PAIRS", 64)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(90, 7)) * spread + 3 * spread, rng.normal(size=(70, 7)) * spread + 3 * spread
    b[:5] = a[:5]
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    limit = np.sort(d, axis=1)[:, 3]
    limit[0], limit[7] = 0.0, np.inf
    got = {(int(i), int(j)): float(v) for part in nb._screened(a, b, limit) for i, j, v in zip(*part)}
    assert all((i, j) in got for i, j in zip(*np.nonzero(d <= limit[:, None]))) and len(got) < 90 * 70 / 4
    assert got[3, 3] == 0.0 and all(got[k] == pytest.approx(d[k], rel=1e-12) for k in got)


def test_queries_look_nearby_first(spark, monkeypatch):
    """Many cells, ids that repeat, duplicates of points and a far point: as all pairs give them."""
    monkeypatch.setattr(nb, "CELL_ROWS", 16)
    monkeypatch.setattr(nb, "GROUP_ROWS", 64)
    rng = np.random.default_rng(6)
    real = rng.normal(size=(400, 5)).round(1)
    real[50:60], real[399] = real[40:50], 100.0
    fake = np.concatenate([real[:200] + 0.01, rng.normal(size=(100, 5)) * 3, real[200:203]])
    frame = lambda m, ids: spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "id bigint, v array<double>")
    points, queries = frame(real, range(400)), frame(fake, [*range(300), 0, 1, 2])
    radii = {r.id: r.radius for r in nb.manifold_radii(points).collect()}
    dd = ((real[:, None] - real[None]) ** 2).sum(2)
    assert radii == pytest.approx(dict(enumerate(np.sort(dd, axis=1)[:, 3])), rel=1e-9, abs=1e-12)
    ball = np.array([radii[i] for i in range(400)])
    d = ((fake[:, None] - real[None]) ** 2).sum(2)
    d = [d[[i, 300 + i]] if i < 3 else d[[i]] for i in range(300)]
    made = spark.createDataFrame(list(radii.items()), "id bigint, radius double")
    rows = {r.id: r for r in nb.in_manifold(queries, points, made).collect()}
    only = {r.id: r.inside for r in nb.in_manifold(queries, points, made, only_inside=True).collect()}
    assert len(rows) == len(only) == 300
    for i, e in enumerate(d):
        assert rows[i].inside == only[i] == bool((e <= ball).any())
        assert rows[i].realism == pytest.approx((ball / (e + nb.REALISM_EPS)).max(), rel=1e-9)
        assert e[:, rows[i].nearest].min() == pytest.approx(e.min(), abs=1e-12)
