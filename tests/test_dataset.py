import pytest
from pyspark.sql import functions as F

from tesserae.functions import core, text, vectors
from tesserae.operators import dataset, sequences, status
from tesserae.session import broadcast_if_small


def test_conversion_keeps_rejected_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "cls string")
    good, bad = dataset.convert(df, "cls")
    assert [r["cls"] for r in good.collect()] == [1] and bad.count() == 2


def test_view_plan_geometry():
    plan = dataset.view_plan(256, 1.1)
    assert [p[1:3] for p in plan[:5]] == [(0, 0), (25, 0), (0, 25), (25, 25), (12, 12)]
    assert [p[3] for p in plan] == [False] * 5 + [True] * 5


def test_positional_pairs_need_equal_counts(spark):
    a, b = spark.range(5).toDF("a"), spark.range(4).toDF("b")
    assert dataset.pair_by_position(a, b, ["a"], ["b"]).count() == 0
    assert dataset.pair_by_position(a, a.toDF("b"), ["a"], [F.desc("b")]).filter("a + b <> 4").count() == 0


def test_empty_evaluation_batch_is_an_error(spark):
    with pytest.raises(ValueError):
        dataset.evaluation_batch(spark.createDataFrame([], "n string"), "n", 5)


def test_rank_split_sizes(spark):
    rows = dataset.split_among_ranks(spark.range(10).toDF("number"), 4)
    assert [r["count"] for r in rows.groupBy("rank").count().orderBy("rank").collect()] == [3, 3, 2, 2]
    few = dataset.split_among_ranks(spark.range(2).toDF("number"), 4)
    assert sorted(r["rank"] for r in few.collect()) == [0, 1]


def test_epoch_has_exact_size(spark):
    rows = spark.createDataFrame([(i // 7, f"{i:03d}") for i in range(40)], "shard bigint, key string")
    out = dataset.resampled_epoch(rows, ["key"], 16, 2)
    got = sorted(r["place"] for r in out.collect())
    assert got == list(range(dataset.epoch_size(40, 16, 2))) and len(got) == 64


def test_uniform_ignores_partitioning(spark):
    df = spark.range(500)
    a = {r["id"]: r["u"] for r in df.withColumn("u", core.uniform("id")).collect()}
    b = {r["id"]: r["u"] for r in df.repartition(13).withColumn("u", core.uniform("id")).collect()}
    assert a == b and 0.4 < sum(a.values()) / 500 < 0.6


def test_masking_covers_at_least_one(spark):
    rows = [(s, p, p) for s in range(50) for p in range(1 + s % 5)]
    df = spark.createDataFrame(rows, "sample_key bigint, pos bigint, code bigint")
    out = sequences.mask_tokens(df, 99).groupBy("sample_key").agg(F.sum(F.col("masked").cast("int")).alias("m"))
    assert out.filter("m < 1").count() == 0


def test_array_helpers(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "a array<int>").select(
        vectors.pad("a", F.lit(5)).alias("p"), vectors.head("a", 2).alias("h"), vectors.joined("a").alias("j")
    ).first()
    assert row["p"] == [1, 2, 3, -1, -1] and row["h"] == [1, 2] and row["j"] == "1,2,3"


def test_checkpoint_steps(spark):
    df = spark.createDataFrame([("checkpoint-10",), ("checkpoint-x",)], "n string")
    assert sorted(r[0] for r in df.select(status.checkpoint_step("n")).collect()) == [-1, 10]


def test_year_turns_at_new_year(spark):
    rows = [("a", 1, "12/31 23:59:59"), ("a", 2, "01/01 00:00:01"), ("b", 1, "03/01 00:00:00"), ("a", 3, "02/29 10:00:00")]
    df = spark.createDataFrame(rows, "run string, n bigint, stamp string")
    out = status.with_year(df, "run", "n", "stamp", 2023).withColumn("y", F.year("at"))
    assert {(r["run"], r["n"]): r["y"] for r in out.collect()} == {("a", 1): 2023, ("a", 2): 2024, ("a", 3): 2024, ("b", 1): 2023}


def test_names(spark):
    df = spark.createDataFrame([("a/7/x.y.jpg", "tar_n012345678.JPEG", 12345678901)], "p string, m string, n bigint")
    row = df.select(text.stem("p"), text.parent_name("p"), text.label_from_name("m"), text.zero_padded("n", 10)).first()
    assert list(row) == ["x.y", "7", "n01234567", "12345678901"]


def test_broadcast_only_when_small(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(broadcast_if_small(spark.range(5))) and not hinted(broadcast_if_small(spark.range(50), 10))
