import random

import pytest

from tesserae.operators.ordering import _slices, number_rows, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(9)) for i in range(3000)]
    rows += [(None, 5000 + i, 1) for i in range(200)]
    rng.shuffle(rows)
    # Keep all slices of this small table.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def expected(rows):
    groups = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((o, v))
    out = {}
    for g, items in groups.items():
        total = 0
        for n, (o, v) in enumerate(items, 1):
            total += v
            out[(g, o)] = (n, total)
    return out


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_positions_do_not_depend_on_the_route(skewed, limit):
    rows, df = skewed
    got = number_rows(df, ["g"], ["o"], "rn", hot_rows=limit).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    assert all(r["rn"] == want[(r["g"], r["o"])][0] for r in got)


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_totals_do_not_depend_on_the_route(skewed, limit):
    rows, df = skewed
    got = running_totals(df, ["g"], ["o"], {"total": "v"}, hot_rows=limit).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    assert all(r["total"] == want[(r["g"], r["o"])][1] for r in got)


def test_whole_table_positions(skewed):
    rows, df = skewed
    got = sorted((r["o"], r["rn"]) for r in number_rows(df, [], ["o"], "rn").collect())
    assert [rn for _, rn in got] == list(range(1, len(rows) + 1))


def test_a_hot_group_is_divided(skewed):
    _, df = skewed
    sliced = _slices(df.filter("g = 'hot'"), ["g"], [])
    assert sliced.select("_slice").distinct().count() >= 6


def test_whole_table_totals_of_nothing(spark):
    df = spark.createDataFrame([], "o bigint, v bigint")
    assert running_totals(df, [], ["o"], {"t": "v"}).count() == 0


def test_whole_table_totals(skewed):
    rows, df = skewed
    got = sorted((r["o"], r["total"]) for r in running_totals(df, [], ["o"], {"total": "v"}, hot_rows=10).collect())
    total, want = 0, []
    for _, o, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want.append((o, total))
    assert got == want
