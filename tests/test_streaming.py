import datetime as dt

from pyspark.sql import functions as F

from tesserae.plans import catalogue
from tesserae.sources import archive
from tesserae.streaming import metrics, run

T0 = dt.datetime(2024, 1, 1)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_counts_grow_over_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "code bigint"
    add(spark, src, [(1,), (1,), (2,)], schema)
    stream = run.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema)
    for more in ([(2,), (3,)], [(1,)]):
        run.update_table(metrics.code_counts(stream), out, out + "-c")
        add(spark, src, more, schema)
    run.update_table(metrics.code_counts(stream), out, out + "-c")
    got = {r["code"]: r["n"] for r in run.current(spark, out, ["code"]).collect()}
    assert got == {1: 3, 2: 2, 3: 1}


def test_late_rows_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, value double"
    add(spark, src, [(T0, 1.0), (T0 + dt.timedelta(hours=10), 2.0)], schema)
    stream = run.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema)
    windows = metrics.throughput(stream, "ts", "value", "1 hour", lateness="2 hours")
    run.update_table(windows, out, out + "-c")
    add(spark, src, [(T0, 50.0), (T0 + dt.timedelta(hours=9), 4.0)], schema)
    run.update_table(windows, out, out + "-c")
    totals = sorted(r["total"] for r in run.current(spark, out, ["start"]).collect())
    assert totals == [1.0, 2.0, 4.0]


def test_latest_status_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "shard bigint, at bigint, line bigint, status string"
    add(spark, src, [(1, 5, 0, "ok"), (1, 5, 1, "bad"), (2, 1, 2, "bad")], schema)
    stream = run.file_stream(spark, src, "*.parquet", spark.read.parquet(src).schema)
    latest = metrics.latest_status(stream, "shard", "at", "line", ["status"])
    run.update_table(latest, out, out + "-c")
    add(spark, src, [(2, 9, 3, "ok")], schema)
    run.update_table(latest, out, out + "-c")
    assert {r["shard"]: r["status"] for r in run.current(spark, out, ["shard"]).collect()} == {1: "ok", 2: "ok"}


def test_archives_are_taken_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def more(shard):
        rows = spark.createDataFrame([(shard, f"{shard}{i}", "txt", b"abc") for i in range(4)], archive.SCHEMA)
        archive.write_members(rows, src)

    more(0)
    stream = run.archive_stream(spark, src)
    run.append_to_table(stream, out, out + "-c")
    more(1)
    run.append_to_table(stream, out, out + "-c")
    run.append_to_table(stream, out, out + "-c")
    got = spark.read.parquet(out)
    assert got.count() == 8 and got.select("key").distinct().count() == 8
    assert got.agg(F.countDistinct("shard")).first()[0] == 2


def test_streams_of_tables_in_one_file_or_many(spark, tmp_path):
    catalogue.load()
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(45)], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(9)], "vec_id bigint, label int, embedding array<float>")
    many, one = tmp_path / "many", tmp_path / "one"
    for name, rows in (("documents", docs), ("embeddings", vectors)):
        rows.repartition(3).write.parquet(str(many / f"{name}.parquet"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        one.mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(one / f"{name}.parquet")
    for name, count in (("t1_incremental_ingest", 45), ("t3_online_inception_score", 1)):
        found = [sorted(catalogue.QUERIES[name](spark, str(folder)).collect()) for folder in (one, many)]
        assert found[0] == found[1] and len(found[0]) == count
