import json
import os

import pytest
from pyspark.sql import functions as F

from tesserae.plans import jobs
from tesserae.sources import archive, files, logs


def test_shard_names():
    assert archive.expand_shards("a/t-{000008..000011}.tar") == [f"a/t-{n:06d}.tar" for n in range(8, 12)]
    assert archive.expand_shards("x.tar,y-{1..2}.tar") == ["x.tar", "y-1.tar", "y-2.tar"]
    assert archive.shard_number("s3://b/dir7/train-000042.tar") == 42
    assert archive.split_member("dir/k1.code_indices.npy") == ("dir/k1", "code_indices.npy")
    assert archive.split_member("noext") is None


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i // 3, f"{i:08d}", f"img{i}".encode(), None if i == 4 else str(i % 2).encode()) for i in range(10)]
    df = spark.createDataFrame(rows, "shard bigint, key string, jpg binary, cls binary")
    path = str(tmp_path / "in")
    archive.write_members(archive.wide_to_members(df, {"jpg": "jpg", "cls": "cls"}), path, "train")
    return path


def test_round_trip_and_pruned_members(spark, folder):
    # Nothing but whole shards is left behind.
    assert sorted(f for f in os.listdir(folder)) == [f"train-{n:06d}.tar" for n in range(4)]
    rows = archive.read_samples(spark, folder)
    assert rows.count() == 19
    assert {r["ext"] for r in archive.read_samples(spark, folder, ["cls"]).collect()} == {"cls"}
    wide = archive.members_to_wide(rows, {"jpg": "jpg", "cls": "cls"})
    by_key = {r["key"]: r for r in wide.collect()}
    assert bytes(by_key["00000007"]["jpg"]) == b"img7" and by_key["00000004"]["cls"] is None
    some = archive.read_samples(spark, os.path.join(folder, "train-{000001..000002}.tar"))
    assert {r["shard"] for r in some.collect()} == {1, 2}


def test_bad_shards_do_not_stop_the_scan(spark, folder):
    with open(os.path.join(folder, "train-000009.tar"), "wb") as f:
        f.write(b"this is not a tar file" * 100)
    path = folder + "," + os.path.join(folder, "train-000077.tar")
    assert archive.read_samples(spark, path).count() == 19
    bad = archive.read_samples(spark, path, errors="report").filter(F.col("ext") == archive.ERROR).collect()
    assert {r["shard"] for r in bad} == {9, 77}


def test_write_samples_cuts_shards(spark, tmp_path):
    df = spark.createDataFrame([(f"n{i:03d}", b"x") for i in range(25)], "name string, jpg binary")
    out = str(tmp_path / "cut")
    archive.write_samples(df, ["name"], {"jpg": "jpg"}, out, "val", 10)
    rows = archive.read_samples(spark, out).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in rows} == {0: 10, 1: 10, 2: 5}


def test_relabel_refuses_in_place(spark, folder):
    with pytest.raises(ValueError):
        jobs.relabel(spark, folder, folder + "/", spark.createDataFrame([("0", 5)], "name string, idx bigint"))


def test_relabel_drops_unknown(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    jobs.relabel(spark, folder, out, spark.createDataFrame([("1", 5)], "name string, idx bigint"))
    wide = archive.members_to_wide(archive.read_samples(spark, out), {"jpg": "jpg", "cls": "cls"}).collect()
    assert {r["key"] for r in wide} == {f"{i:08d}" for i in range(1, 10, 2)}
    assert {bytes(r["cls"]) for r in wide} == {b"5"}


def test_folder_reader_skips_bad_labels(spark, tmp_path):
    for d, n in (("3", "a.JPEG"), ("x", "b.jpg"), ("12", "c.d.jpg"), ("3", "skip.txt")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_bytes(b"123")
    rows = files.read_folder(spark, str(tmp_path)).collect()
    assert {(r["key"], r["cls"]) for r in rows} == {("a", 3), ("c.d", 12)}


def test_json_readers(spark, tmp_path):
    tree = {"status_data": [1, 1, 0, -1], "final_tree": {"0": [{"patch_index": 0, "lod_level": 0}], "1": [{"patch_index": 2, "lod_level": 1}]}}
    (tmp_path / "tree.json").write_text(json.dumps(tree, indent=1))
    got = files.read_fixed_tree(spark, str(tmp_path / "tree.json")).collect()
    assert {(r["lod"], r["patch"]) for r in got} == {(0, 0), (1, 2)}
    status = files.read_fixed_status(spark, str(tmp_path / "tree.json")).orderBy("idx").collect()
    assert [r["status"] for r in status] == [1, 1, 0, -1]
    found = [{"image_id": 1, "category_id": 2, "bbox": [1.0, 2.0, 3.0, 4.0], "score": 0.5}]
    (tmp_path / "det.json").write_text(json.dumps(found))
    assert files.read_detections(spark, str(tmp_path / "det.json")).first()["h"] == 4.0
    (tmp_path / "match.json").write_text('{"0": 0, "7": 3}')
    assert {(r["source"], r["target"]) for r in files.read_match_map(spark, str(tmp_path / "match.json")).collect()} == {(0, 0), (7, 3)}


def test_logs(spark, tmp_path):
    line = "[03/14 01:02:03 Invented]: Data (t): 0.0250, 12.50/s/gpu Batch (t): 0.5000 LR: 0.000300 Step: 1200 Loss: 4.2500 Token Acc: 0.1250 "
    (tmp_path / "run_1.out").write_text(line + "\nother text\n")
    row = logs.parse_training_log(files.read_logs(spark, str(tmp_path))).collect()
    assert len(row) == 1 and row[0]["file"] == "run_1.out" and row[0]["rate"] == 12.5
    assert row[0]["step"] == 1200 and row[0]["loss"] == 4.25 and row[0]["token_acc"] == 0.125
    names = spark.createDataFrame([("check_files_77_5.out",), ("else.out",)], "file string")
    assert [(r["task_id"], r["shard"]) for r in logs.parse_check_names(names).collect()] == [(77, 5)]


def test_resumed_job_repeats_failed_shards(spark, tmp_path):
    rows = spark.createDataFrame([(s, i) for s in range(4) for i in range(3)], "shard bigint, v bigint")
    wanted = spark.createDataFrame([(s,) for s in range(6)], "shard bigint")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def step(bad):
        return lambda df: df.withColumn("error", F.when(F.col("shard") == bad, F.lit("broken")))

    one = {r["shard"]: r["status"] for r in jobs.run_resumable(wanted, rows, step(2), out, log, "one").collect()}
    assert one == {0: "SUCCESS", 1: "SUCCESS", 2: "FAILED", 3: "SUCCESS", 4: "SKIPPED", 5: "SKIPPED"}
    two = {r["shard"]: r["status"] for r in jobs.run_resumable(wanted, rows, step(-1), out, log, "two").collect()}
    assert two == {0: "SKIPPED", 1: "SKIPPED", 2: "SUCCESS", 3: "SKIPPED", 4: "SKIPPED", 5: "SKIPPED"}
    assert spark.read.parquet(out).count() == 12


def test_resumed_job_deals_small_shards_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "TASK_FOLDERS", 8, raising=False)
    rows = spark.range(400).select((F.col("id") % 100).alias("shard"), F.col("id").alias("bytes"), F.lit(None).alias("bad").cast("int"))
    out, log = tmp_path / "out", str(tmp_path / "log")
    step = lambda df: df.withColumn("error", F.when(F.col("shard") == 7, F.lit("broken")))
    status = jobs.run_resumable(rows.select("shard"), rows, step, str(out), log, "one").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {"SUCCESS": 99, "FAILED": 1}
    files = list(out.glob("shard=*/*.parquet"))
    assert len(files) == 99 and not (out / "shard=7").exists()
    # The number of its task stands in the name of a file.
    assert len({f.name.split("-")[1] for f in files}) > 8
    back = spark.read.parquet(str(out))
    assert sorted(back.columns) == ["bad", "bytes", "shard"]
    assert sorted((r["shard"], r["bytes"]) for r in back.collect()) == sorted((i % 100, i) for i in range(400) if i % 100 != 7)


def test_resumed_job_deals_a_large_shard_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "PART_BYTES", 4096, raising=False)
    text, pair = F.repeat(F.lit("x"), 200).alias("text"), F.array("id", "id").alias("pair")
    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 5 + 1).alias("shard"), text, pair)
    out, log = tmp_path / "out", str(tmp_path / "log")
    wanted = rows.select("shard")
    step = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    # What an interrupted run left behind is replaced.
    rows.filter("shard = 0").write.partitionBy("shard").parquet(str(out))
    assert jobs.run_resumable(wanted, rows, step, str(out), log, "one").filter("status = 'SUCCESS'").count() == 6
    assert len(list((out / "shard=0").glob("*.parquet"))) > 4
    back = spark.read.parquet(str(out))
    assert sorted((r["shard"], r["pair"][0], r["pair"][1], len(r["text"])) for r in back.collect()) == sorted(
        (0 if i < 200 else i % 5 + 1, i, i, 200) for i in range(300)
    )


def test_extensions_lose_their_case():
    assert archive.split_member("a/b.JPEG") == ("a/b", "jpeg") and archive.split_member("c.Seg.PNG") == ("c", "seg.png")


def test_progress_lines_with_paths(spark):
    text = [
        "[Mon] SKIPPED: /data/run7-shared/v2/train-000012.tar (not found)",
        "[Mon] SKIPPED: /data/run7/out-3.tar.gz (already exists)",
        "[Mon] SUCCESS: Shard 000004 completed on GPU 1",
        "[Mon] FAILED: Shard 5 failed on GPU 0 with exit code 9",
        "[Mon] SKIPPED: 6",
        "[Mon] STARTED: Shard 1",
    ]
    rows = logs.parse_progress_log(spark.createDataFrame([(t,) for t in text], "line string")).collect()
    assert [tuple(r) for r in rows] == [("SKIPPED", 12), ("SKIPPED", 3), ("SUCCESS", 4), ("FAILED", 5), ("SKIPPED", 6)]


def test_check_logs(spark):
    bodies = ["文件索引: 7\n✅ 文件 a 正常, 共 12 个样本", "文件索引: 8\n❌ 文件 b 错误 - short read \nmore", "文件索引: 9\n", "else"]
    rows = logs.parse_check_logs(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "file string, content string"))
    want = [("0", 7, "ok", 12, None), ("1", 8, "error", 0, "short read"), ("2", 9, "unknown", 0, None)]
    assert [tuple(r) for r in rows.collect()] == want
