from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.operators import tree


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "tree_id")


def nodes_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["tree_id"]].add((r["lod"], r["patch"]))
    return out


def up(lod, patch):
    side = geo.SIDES[lod]
    return lod - 1, (patch // side // 2) * (side // 2) + (patch % side) // 2


def test_complete_tree_has_every_cell(spark):
    got = nodes_of(tree.complete_trees(ids(spark, 2)))
    want = {(l, p) for l, s in enumerate(geo.SIDES) for p in range(s * s)}
    assert len(want) == 1365 and got[0] == want and got[1] == want


def test_breadth_first_order_follows_parents(spark):
    rows = tree.ordered(tree.complete_trees(ids(spark, 1))).orderBy("pos").collect()
    assert [r["idx"] for r in rows] == list(range(1365))
    place = {(r["lod"], r["patch"]): r["pos"] for r in rows}
    for r in rows:
        if r["lod"]:
            # The four children of a node follow each other in the order of their parents.
            first = (r["level_pos"] // 4) * 4
            siblings = [x for x in rows if x["lod"] == r["lod"] and first <= x["level_pos"] < first + 4]
            assert {up(x["lod"], x["patch"]) for x in siblings} == {up(r["lod"], r["patch"])}
            break
    parents = [place[up(r["lod"], r["patch"])] for r in rows if r["lod"] == 5]
    assert parents == sorted(parents)


def test_tree_size_statistics_match_published_means(spark):
    stats = {r["lod"]: r for r in tree.size_statistics(tree.probabilistic_trees(ids(spark, 2000), 3, [0.3, 0.2])).collect()}
    for lod, count in ((0, 1), (1, 4), (2, 16), (3, 64)):
        assert stats[lod]["min"] == stats[lod]["max"] == count
    assert abs(stats[4]["mean"] - 76.8) < 1.5
    assert abs(stats[5]["mean"] - 61.4) < 2.5
    assert abs(stats[-1]["mean"] - 223) < 4
    assert abs(sum(stats[l]["share"] for l in range(6)) - 100) < 1e-9


def test_missing_probability_stops_growth(spark):
    assert tree.probabilistic_trees(ids(spark, 20), 3, [1.0]).agg(F.max("lod")).first()[0] == 4


def test_random_size_trees(spark):
    grown = nodes_of(tree.random_size_trees(ids(spark, 60), 10, 100, guaranteed_depth=2, seed=5))
    inner = set()
    for nodes in grown.values():
        assert (len(nodes) - 1) % 4 == 0
        count = (len(nodes) - 1) // 4
        assert 10 <= count <= 100
        inner.add(count)
        assert {n for n in nodes if n[0] <= 2} == {(l, p) for l in range(3) for p in range(4**l)}
        assert all(n[0] == 0 or up(*n) in nodes for n in nodes)
    assert len(inner) > 20
    raised = nodes_of(tree.random_size_trees(ids(spark, 3), 0, 1, guaranteed_depth=3))
    assert {len(n) for n in raised.values()} == {1 + 4 * 21}


def test_orphans_and_their_descendants_go(spark):
    whole = tree.complete_trees(ids(spark, 3), 4)
    broken = whole.filter(~((F.col("lod") == 2) & (F.col("patch") == 5)))
    got = nodes_of(tree.reachable(broken))
    want = {n for n in nodes_of(broken)[0]}
    for _ in range(5):
        want = {n for n in want if n[0] == 0 or up(*n) in want}
    assert got[0] == want and len(want) == 341 - 21


def test_status_vector_and_split_labels(spark):
    nodes = tree.probabilistic_trees(ids(spark, 5), 2, [0.5, 0.5])
    present = nodes_of(nodes)
    marked = tree.marked_candidates(nodes)
    order = [(r["lod"], r["patch"]) for r in tree.ordered(tree.complete_trees(ids(spark, 1))).orderBy("pos").collect()]
    for row in tree.status_vectors(marked).collect():
        own = present[row["tree_id"]]
        want = [1 if n in own else 0 if n[0] and up(*n) in own else -1 for n in order]
        assert row["status"] == want
    two = tree.status_vectors(marked, candidates=False).filter("tree_id = 0").first()["status"]
    assert two == [1 if n in present[0] else -1 for n in order]
    labels = {(r["tree_id"], r["pos"]): r["label"] for r in tree.split_labels(marked, 2).collect()}
    for t, own in present.items():
        active = [n for n in order if n in own or (n[0] and up(*n) in own)]
        want = {(t, i): int(n in own) for i, n in enumerate(active) if 2 <= n[0] < 5}
        assert {k: v for k, v in labels.items() if k[0] == t} == want


def test_pruning_removes_whole_subtrees(spark):
    full = tree.complete_trees(ids(spark, 2))
    drops = full.filter(F.col("lod").isin(3, 4)).withColumn(
        "drop", F.when(F.col("patch") % 3 == 0, 0.1).otherwise(0.9)
    )
    got = nodes_of(tree.prune(full, drops))
    want = set()
    for lod, patch in nodes_of(full)[0]:
        chain, node = [], (lod, patch)
        while node[0] > 0:
            node = up(*node)
            chain.append(node)
        if not any(n[0] in (3, 4) and n[1] % 3 == 0 for n in chain):
            want.add((lod, patch))
    assert got[0] == want == got[1]


def test_single_candidate_is_not_chosen(spark):
    rows = spark.createDataFrame([(1, 3, 0, 0.4), (2, 3, 0, 0.1), (2, 3, 1, 0.3)], "tree_id bigint, lod bigint, patch bigint, gain double")
    chosen = tree.choose_splits(rows).filter("chosen").collect()
    assert [(r["tree_id"], r["patch"]) for r in chosen] == [(2, 1)]


def test_roll_up_of_leaf_is_zero(spark):
    nodes = tree.complete_trees(ids(spark, 1), 2).withColumn("val", F.lit(7.0))
    assert {r["val"] for r in tree.roll_up(nodes, "val").collect()} == {0.0}


def test_node_tables_stay_partitioned_by_tree(spark):
    nodes = tree.with_parents(tree.probabilistic_trees(ids(spark, 10), 3, [0.3, 0.2]))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("level", [0, 2, 5])
def test_nodes_at_level(spark, level):
    full = tree.complete_trees(ids(spark, 1))
    assert tree.nodes_at_level(full, level).count() == 4**level
    assert tree.copy_to_depth(full, level).agg(F.max("lod")).first()[0] == level


def test_tasks_of_trees_grow_in_number(spark, monkeypatch):
    """Full trees of one task fit its memory, however many trees there are."""
    monkeypatch.setattr(tree, "TASK_TREES", 10)
    ids = spark.range(300).withColumnRenamed("id", "tree_id")
    nodes = tree.complete_trees(ids, 1)
    assert nodes.rdd.getNumPartitions() == 30
    assert nodes.count() == 300 * 5
    assert tree.random_size_trees(ids, 1, 3).rdd.getNumPartitions() == 30
