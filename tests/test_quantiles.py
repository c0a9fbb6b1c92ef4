"""Exact quantiles by refinement, against numpy."""

import numpy as np
import pytest

from tesserae.operators import grid, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def of(spark, values, shares=SHARES):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    return [r.value for r in quantiles.exact_percentiles(df, "v", shares).orderBy("share").collect()]


def test_bits_keep_the_order_and_come_back():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, np.inf, -np.inf, 5e-324]])
    bits = quantiles.ordered_bits(values)
    assert (np.argsort(bits, kind="stable") == np.argsort(values, kind="stable")).all()
    assert [quantiles.of_bits(int(b)) for b in bits] == values.tolist()
    assert quantiles.ordered_bits(np.array([-0.0]))[0] == quantiles.ordered_bits(np.array([0.0]))[0]


@pytest.mark.parametrize("kind", ["normal", "ties", "close", "spread"])
def test_against_numpy(spark, kind):
    rng = np.random.default_rng(11)
    values = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(-3, 3, 2000).astype(float),
        # All alike in their first 48 bits.
        "close": np.nextafter(1.0, 2.0) + np.arange(1500) * np.finfo(float).eps,
        "spread": rng.normal(size=1000) * 10.0 ** rng.integers(-250, 250, 1000),
    }[kind]
    assert np.allclose(of(spark, values.tolist()), np.percentile(values, [100 * s for s in SHARES]), rtol=1e-12, atol=0)


def test_nulls_nan_and_single_values(spark):
    assert of(spark, [None, 2.0, None, 1.0, None], [0.0, 0.5, 1.0]) == [1.0, 1.5, 2.0]
    assert of(spark, [7.5], [0.0, 0.3, 1.0]) == [7.5] * 3
    assert of(spark, [float("-inf"), float("-inf"), 0.0], [0.0, 0.25, 1.0]) == [float("-inf")] * 2 + [0.0]
    low, high = of(spark, [float("nan"), -1.0], [0.0, 1.0])
    assert low == -1.0 and np.isnan(high)
    assert of(spark, [None, None], [0.5]) == [None] and of(spark, [], [0.2, 0.5]) == [None, None]
    with pytest.raises(ValueError):
        of(spark, [1.0], [1.5])


def test_nothing_but_counts_is_shuffled(spark):
    df = spark.range(1000).selectExpr("cast(id as double) AS v")
    plan = quantiles._digits(df, [0], 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    assert "partial_sum(n" in plan


def test_distribution_of_an_empty_table(spark):
    rows = grid.distribution(spark.createDataFrame([], "x double"), "x", [0.5], 1.0).collect()
    assert {r.name for r in rows} == {"mean", "std", "min", "max", "below", "p50"} and all(r.value is None for r in rows)
