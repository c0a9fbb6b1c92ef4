"""Merge trees and states of streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import accumulate, quality
from tesserae.streaming import metrics, run


def vectors(spark, m, parts):
    rows = [([float(x) for x in v],) for v in m]
    return spark.createDataFrame(rows, "v array<double>").repartition(parts)


@pytest.mark.parametrize("fan,numbers", [(2, 1), (3, 40), (64, 1 << 17)])
def test_moments_through_a_merge_tree(spark, monkeypatch, fan, numbers):
    monkeypatch.setattr(accumulate, "FAN", fan)
    m = np.random.default_rng(fan).normal(size=(300, 7))
    parts = accumulate.partial(vectors(spark, m, 19), "v", accumulate.MOMENTS)
    rows = accumulate.moments(accumulate.merged(parts, accumulate.MOMENTS)).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(7)) and {r.n for r in rows} == {300}
    assert np.allclose([r.s for r in rows], m.sum(0)) and np.allclose([r.g for r in rows], m.T @ m)
    # Tiles of a state for themselves: any cut gives the same rows.
    monkeypatch.setattr(accumulate, "TILE_NUMBERS", numbers)
    state = accumulate.MOMENTS.update(accumulate.MOMENTS.init(), m)
    tiles = spark.createDataFrame([(k, v.tolist()) for k, v in accumulate.MOMENTS.tiles(state).items()], accumulate.TILES)
    again = accumulate.moments(tiles).orderBy("i").collect()
    assert np.allclose([r.g for r in again], m.T @ m) and [r.i for r in again] == list(range(7))


def test_no_group_grows_with_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(accumulate, "FAN", 4)
    parts = spark.range(1000).select(F.col("id").alias("part"), F.lit(0).cast("bigint").alias("tile"), F.array(F.lit(1.0)).alias("value"))
    sizes = []
    frame = type(parts)
    real = frame.groupBy

    def counted(self, *cols):
        if cols == ("tile", "up"):
            sizes.append(real(self, *cols).count().agg(F.max("count")).first()[0])
        return real(self, *cols)

    monkeypatch.setattr(frame, "groupBy", counted)
    got = accumulate.merged(parts, accumulate.Accumulator(lambda: None, None, None)).collect()
    assert [(r.tile, r.value) for r in got] == [(0, [1000.0])] and len(sizes) == 5 and max(sizes) <= 4


def test_other_merges_null_vectors_and_empty_tables(spark):
    largest = accumulate.Accumulator(lambda: -np.inf, lambda s, m: np.maximum(s, m.max(0)), lambda s: {0: s}, np.maximum)
    m = np.random.default_rng(1).normal(size=(50, 3))
    df = vectors(spark, m, 6).unionByName(spark.createDataFrame([(None,)], "v array<double>"))
    assert np.allclose(accumulate.accumulate(df, "v", largest).first().value, m.max(0))
    assert quality.moment_sums(df.limit(0), "v").count() == 0
    assert quality.moment_sums(df.filter("v IS NULL"), "v").count() == 0
    assert quality.moment_sums(df, "v").first().n == 50


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_online_moments_count_every_batch_once(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    m = np.random.default_rng(2).normal(size=(90, 4))
    lots = [[([float(x) for x in v],) for v in part] for part in np.split(m, 6)]
    add(spark, src, lots[0], "v array<double>")
    stream = run.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema)
    metrics.online_moments(stream, "v", out, out + "-c")
    # The second batch is stored, then fails before it is committed: it is repeated.
    add(spark, src, lots[1], "v array<double>")
    real, calls = run._remove, []

    def lost(*args):
        calls.append(args)
        raise RuntimeError("lost after the state was written")

    monkeypatch.setattr(run, "_remove", lost)
    with pytest.raises(Exception):
        metrics.online_moments(stream, "v", out, out + "-c")
    monkeypatch.setattr(run, "_remove", real)
    assert calls and run._versions(out, "state") == [0, 1]
    for lot in lots[2:]:
        add(spark, src, lot, "v array<double>")
        metrics.online_moments(stream, "v", out, out + "-c")
    rows = metrics.current_moments(spark, out).orderBy("i").collect()
    assert {r.n for r in rows} == {90} and np.allclose([r.g for r in rows], m.T @ m)
    assert len(run._versions(out, "state")) == 2


def test_history_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "FOLD", 4)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    r = np.random.default_rng(3)
    add(spark, src, [(0,)], "code bigint")
    want[0] = 1
    stream = run.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema, files_per_trigger=1)
    for _ in range(14):
        codes = r.integers(0, 6, 3).tolist()
        add(spark, src, [(c,) for c in codes], "code bigint")
        for c in codes:
            want[c] = want.get(c, 0) + 1
    run.update_table(metrics.code_counts(stream), out, out + "-c", ["code"])
    assert {x.code: x.n for x in run.current(spark, out, ["code"]).collect()} == want
    assert len([d for d in os.listdir(out) if "=" in d]) <= 5 and run._versions(out, "snapshot") == [11]
    # A batch that is stored and folded again changes nothing.
    number = run._versions(out, "batch")[0]
    assert number == 11
    batch = spark.read.parquet(f"{out}/batch={number}")
    batch.write.mode("overwrite").parquet(f"{out}/again")
    spark.read.parquet(f"{out}/again").write.mode("overwrite").parquet(f"{out}/batch={number}")
    run.fold(spark, out, ["code"], 14)
    assert {x.code: x.n for x in run.current(spark, out, ["code"]).collect()} == want
