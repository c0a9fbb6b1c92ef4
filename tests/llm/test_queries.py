"""The registered queries on the smallest tables: SQL, held-out accuracy, and the pipeline."""

import collections
import importlib.util
import os

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _module(name, path):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


check = _module("check_tool", "tools/check.py")
pipeline = _module("corpus_pipeline", "corpus_pipeline.py")

from tesserae.llm import decontamination, near_dedup, quality_rules  # noqa: E402
from tesserae.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, con, name):
    verdict = check.compare(QUERIES[name](spark, small), con, SQL[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_quality_rules_agree_with_labels(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    rows = QUERIES["op1_quality_rules"](spark, small).filter("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.label == 1) for r in rows) / len(rows) > 0.95
    assert all(r.kept for r in rows if r.label == 1)


def test_language_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op10_language_id"](spark, small).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("shard", F.lit("mine"))
    before = docs
    for number, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, small)
        if number < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    scored = quality_rules.score(quality_rules.measure(before)).filter("kept").select("doc_id")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(read(0)) == ids(scored)
    classes = near_dedup.classes(read(0).select("doc_id", "text"))
    assert ids(read(1)) == ids(classes.filter("doc_id = class_id"))
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids(read(2)) == ids(decontamination.with_matches(read(1), bench).filter(F.size("matches") == 0))
    items = [r.text for r in bench.collect()]
    assert not any(i in r.text for r in read(2).collect() for i in items)
    assert set(ids(read(3))) <= set(ids(read(2))) and max(collections.Counter(ids(read(3))).values()) <= 3
    assert ids(read(4)) == ids(read(3))
    sizes = collections.Counter(r.shard for r in read(4).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_on_empty_and_odd_tables(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], schema)
    for rows in (spark.createDataFrame([], schema), odd):
        docs = rows.withColumns({"size": F.lit(1), "taken": F.lit(2), "n_words": F.lit(3)})
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
        assert docs.count() == 0
