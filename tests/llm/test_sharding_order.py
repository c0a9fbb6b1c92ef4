"""Quantisation over the whole order of any column, and what shards let readers skip."""

import collections
import datetime as dt
import decimal

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import sharding


def cells_of(spark, rows, kind, bits=6):
    df = spark.createDataFrame([(v,) for v in rows], f"v {kind}")
    return {r.v: r.c for r in sharding.with_curve(df, ["v"], "c", bits).collect()}


def test_long_shared_beginnings_keep_their_order(spark):
    urls = [f"https://www.example.org/{i:04d}" for i in range(100)]
    got = cells_of(spark, urls * 3, "string")
    order = [got[u] for u in urls]
    assert order == sorted(order) and len(set(order)) >= 50
    assert max(collections.Counter(order).values()) <= 2


def test_nulls_fractions_and_other_types(spark):
    got = cells_of(spark, [None, -5, -1, 0, 7], "bigint")
    assert got[None] < got[-5] < got[-1] < got[0] < got[7]
    got = cells_of(spark, [None, -0.5, 0.1, 0.2, 0.9, 1.0], "double")
    assert len(set(got.values())) == 6 and got[None] < got[-0.5] < got[0.1] < got[0.2] < got[0.9] < got[1.0]
    days = [dt.date(1960, 1, 1), dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    got = cells_of(spark, [None, *days], "date")
    assert [got[d] for d in (None, *days)] == sorted(got.values()) and len(set(got.values())) == 4
    got = cells_of(spark, [None, *map(decimal.Decimal, ("1.1", "1.2", "3"))], "decimal(5,2)")
    assert len(set(got.values())) == 4
    got = cells_of(spark, [None, "", "a", "é", "z"], "string")
    assert got[None] < got[""] < got["a"] < got["z"] < got["é"]
    assert cells_of(spark, [None, None], "string") == {None: 0} and cells_of(spark, [], "string") == {}


def test_a_hot_value_leaves_others_apart(spark):
    values = ["hot"] * 500 + [f"name-with-a-long-beginning-{i:03d}" for i in range(250)]
    got = cells_of(spark, values, "string")
    assert len(set(got.values())) >= 20


def test_shards_let_readers_skip_files(spark):
    """With URL-like sources, a shard covers a small range of each dimension."""
    r = np.random.default_rng(4)
    rows = [(i, f"https://www.example.org/section/{r.integers(64):03d}", int(r.integers(1000))) for i in range(6400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    out = sharding.assign(df, ["source", "size"], ["doc_id"], 64)
    spans = out.groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("size").alias("c"), F.max("size").alias("d")).collect()
    sources = sum(int(s.b[-3:]) - int(s.a[-3:]) + 1 for s in spans) / len(spans)
    sizes = sum(s.d - s.c + 1 for s in spans) / len(spans)
    # Rows in any order would give spans of all 64 sources and about 980 sizes.
    assert sources < 20 and sizes < 320
