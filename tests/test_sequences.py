"""Token sequences on rows of their own."""

from pyspark.sql import functions as F

from tesserae.operators import sequences

ROWS = "sample_key bigint, pos bigint, code bigint"


def test_next_tokens_across_blocks_gaps_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 3, raising=False)
    rows = [(1, p, 10 + p) for p in range(8)] + [(2, 0, 5), (2, 0, 7), (2, 1, 6), (2, 3, 4), (2, 4, None), (2, 5, -1), (2, 6, -1)]
    got = {(r.sample_key, r.pos): (r.input, r.target, r.valid) for r in sequences.next_token_pairs(spark.createDataFrame(rows, ROWS)).collect()}
    want = {(1, p): (10 + p - 1 if p else None, 10 + p, True) for p in range(8)}
    want |= {(2, 0): (None, 7, True), (2, 1): (7, 6, True), (2, 3): (None, 4, True), (2, 5): (None, -1, False), (2, 6): (0, -1, False)}
    assert got == want


def test_next_tokens_keep_no_table_of_rows_in_memory(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("sample_key"), F.col("id").alias("pos"), F.col("id").alias("code"))
    plan = sequences.next_token_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1
