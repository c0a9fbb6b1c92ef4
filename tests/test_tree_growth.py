"""Trees are grown by code that Spark compiles."""

from tesserae.operators import tree


def test_growth_has_no_lambda_and_one_explode_for_full_levels(spark):
    ids = spark.range(10).withColumnRenamed("id", "tree_id")
    plan = tree.probabilistic_trees(ids, 3, [0.3, 0.2])._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("Generate explode") == 3


def test_levels_that_do_not_start_at_one_cell(spark):
    ids = spark.createDataFrame([(1, "a"), (None, "b")], "tree_id bigint, kind string")
    rows = tree.complete_trees(ids, sides=(2, 4)).collect()
    assert sorted(tuple(r) for r in rows if r.kind == "a") == [(1, "a", 0, 0), (1, "a", 1, 0), (1, "a", 1, 1), (1, "a", 1, 4), (1, "a", 1, 5)]
    assert len(rows) == 10 and tree.complete_trees(ids, 0).count() == 2
