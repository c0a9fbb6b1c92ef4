"""Queries over quadtrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import geometry as geo
from tesserae.functions.core import rounded, uniform
from tesserae.functions.vectors import joined
from tesserae.operators import level_arrays, sequences, tree
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import parent, r, u, view, zorder
from tesserae.plans.views import GUARANTEED_DEPTH, Tables
from tesserae.session import scratch
from tesserae.sources import tokens as token_io

_IDX = f"((1 << (2 * lod)::INTEGER) - 1) // 3 + {zorder('lod', 'patch')}"
view("nodes", f"SELECT tree_id, lod, patch, {_IDX} AS idx FROM trees", "trees")
view(
    "gains",
    f"""SELECT c_custkey AS tree_id, lod, patch, {_IDX} AS idx,
          {u("'gain'", "c_custkey", "lod", "patch")} - 0.5 AS gain FROM customer, full_tree""",
    "full_tree",
)


#: All patches of a group as one text, so that node sets of many trees compare row by row.
PATCHES = "string_agg(patch::VARCHAR, ',' ORDER BY patch) AS patches"


def _patches(nodes, *group: str):
    return nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), joined(F.array_sort(F.collect_list("patch"))).alias("patches"))


@query(
    "q1_complete_tree",
    f"""SELECT c_custkey AS tree_id, lod, count(*) AS n, {PATCHES} FROM customer, full_tree
       GROUP BY c_custkey, lod""",
    "full_tree",
)
def _(t: Tables):
    return _patches(tree.complete_trees(t.tree_ids), "tree_id", "lod")


@query("q2_random_trees", "SELECT * FROM trees", "trees")
def _(t: Tables):
    return t.trees


@query("q3_trees_by_size")
def _(t: Tables):
    grown = tree.random_size_trees(t.tree_ids, 10, 100, guaranteed_depth=2)
    inner = (F.count(F.lit(1)) - 1) / 4
    return grown.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), inner.cast("bigint").alias("internal"))


@query(
    "q4_depth_and_level",
    f"""SELECT 'copy' AS part, tree_id, lod, count(*) AS n, {PATCHES} FROM trees WHERE lod <= 4 GROUP BY tree_id, lod
       UNION ALL SELECT 'level', tree_id, lod, count(*), {PATCHES} FROM trees WHERE lod = 4 GROUP BY tree_id, lod""",
    "trees",
)
def _(t: Tables):
    copy = _patches(tree.copy_to_depth(t.trees, 4), "tree_id", "lod")
    level = _patches(tree.nodes_at_level(t.trees, 4), "tree_id", "lod")
    return copy.select(F.lit("copy").alias("part"), "*").unionByName(
        level.select(F.lit("level").alias("part"), "*")
    )


@query(
    "w8_breadth_first_order",
    """SELECT tree_id, lod, patch, row_number() OVER (PARTITION BY tree_id ORDER BY idx) - 1 AS pos,
         row_number() OVER (PARTITION BY tree_id, lod ORDER BY idx) - 1 AS level_pos FROM nodes""",
    "nodes",
)
def _(t: Tables):
    return tree.ordered(t.trees).drop("idx")


_LOST = f"SELECT * FROM nodes WHERE {u(chr(39) + 'lost' + chr(39), 'tree_id', 'idx')} >= 0.01 OR lod = 0"
_REACH = "WITH kept AS (" + _LOST + "), r0 AS (SELECT * FROM kept WHERE lod = 0)" + "".join(
    f""", r{k} AS (SELECT k.* FROM kept k JOIN r{k - 1} q ON q.tree_id = k.tree_id AND q.patch = {parent("k.lod", "k.patch")}
        WHERE k.lod = {k})"""
    for k in range(1, 6)
) + ", reach AS (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(6)) + """),
   placed AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY idx) - 1 AS pos FROM reach)
"""


@query(
    "j5_parent_links",
    _REACH
    + f"""SELECT a.tree_id, a.lod, a.patch, a.idx, a.pos, coalesce(b.pos, -1) AS parent_pos FROM placed a
          LEFT JOIN placed b ON a.lod > 0 AND b.tree_id = a.tree_id AND b.lod = a.lod - 1
            AND b.patch = {parent("a.lod", "a.patch")}""",
    "nodes",
)
def _(t: Tables):
    lost = uniform(F.lit("lost"), "tree_id", level_arrays.index_of("lod", "patch")) < 0.01
    kept = t.trees.filter(~lost | (F.col("lod") == 0))
    return tree.with_parents(kept)


_STATUS_TEXT = f"string_agg(status::VARCHAR, ',' ORDER BY {_IDX})"


@query(
    "j6_candidate_marking",
    f"""SELECT tree_id, {_STATUS_TEXT} AS status,
          string_agg(CASE WHEN status = 1 THEN 1 ELSE -1 END::VARCHAR, ',' ORDER BY {_IDX}) AS present,
          count(*) FILTER (status >= 0) AS active FROM node_status GROUP BY tree_id""",
    "node_status",
)
def _(t: Tables):
    vectors = tree.status_vectors(t.trees)
    present = F.transform("status", lambda s: F.when(s == 1, F.lit(1)).otherwise(F.lit(-1)))
    active = F.size(F.filter("status", lambda s: s >= 0)).cast("bigint")
    return vectors.select("tree_id", joined("status").alias("status"), joined(present).alias("present"), active.alias("active"))


@query(
    "j6_candidate_rows",
    f"""SELECT tree_id, lod, status, count(*) AS n, {PATCHES} FROM node_status WHERE status >= 0
        GROUP BY tree_id, lod, status""",
    "node_status",
)
def _(t: Tables):
    return _patches(tree.marked_candidates(t.trees), "tree_id", "lod", "status")


@query(
    "j16_split_labels",
    f"""SELECT tree_id, pos, label FROM (SELECT tree_id, lod, status AS label,
            row_number() OVER (PARTITION BY tree_id ORDER BY {_IDX}) - 1 AS pos FROM node_status WHERE status >= 0)
        WHERE lod >= 3 AND lod < 5""",
    "node_status",
)
def _(t: Tables):
    return tree.split_labels(t.trees, GUARANTEED_DEPTH)


@query(
    "a21_tree_sizes",
    f"""WITH c AS (SELECT t.tree_id, l.lod, count(n.patch) AS n, any_value(w.whole) AS whole
          FROM (SELECT c_custkey AS tree_id FROM customer) t CROSS JOIN (SELECT unnest(range(6)) AS lod) l
          JOIN (SELECT tree_id, count(*) AS whole FROM trees GROUP BY tree_id) w ON w.tree_id = t.tree_id
          LEFT JOIN trees n ON n.tree_id = t.tree_id AND n.lod = l.lod GROUP BY t.tree_id, l.lod),
        every AS (SELECT * FROM c UNION ALL SELECT tree_id, -1, any_value(whole), any_value(whole) FROM c GROUP BY tree_id)
        SELECT lod, count(*) AS trees, min(n) AS min, max(n) AS max, {r("avg(n)")} AS mean,
          list_sort(list(n))[count(*) // 2 + 1] AS median, {r("100.0 * sum(n) / sum(whole)")} AS share
        FROM every GROUP BY lod""",
    "trees",
)
def _(t: Tables):
    out = tree.size_statistics(t.trees)
    return out.withColumn("mean", rounded("mean")).withColumn("share", rounded("share"))


@query(
    "a24_heat_map",
    """WITH h AS (SELECT n.tree_id, y, x, count(*) AS heat FROM trees n,
         LATERAL (SELECT unnest(range((n.patch // (1 << n.lod::INT)) * (32 >> n.lod::INT),
            (n.patch // (1 << n.lod::INT) + 1) * (32 >> n.lod::INT))) AS y) ys,
         LATERAL (SELECT unnest(range((n.patch % (1 << n.lod::INT)) * (32 >> n.lod::INT),
            (n.patch % (1 << n.lod::INT) + 1) * (32 >> n.lod::INT))) AS x) xs
         GROUP BY n.tree_id, y, x)
       SELECT tree_id, count(*) AS cells, max(heat) AS hottest,
         string_agg(heat::VARCHAR, ',' ORDER BY y, x) AS heats FROM h GROUP BY tree_id""",
    "trees",
)
def _(t: Tables):
    heat = tree.heat_map(t.trees)
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "heat")))
    return heat.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.max("heat").alias("hottest"),
        joined(F.transform(cells, lambda c: c["heat"])).alias("heats"),
    )


_CHOSEN = """(SELECT c.*, row_number() OVER (PARTITION BY tree_id, lod ORDER BY gain DESC, patch) AS place,
     floor((sum((gain > mean)::INT) OVER (PARTITION BY tree_id, lod)) * CASE WHEN lod = 4 THEN 1.5 ELSE 1 END) AS wanted
   FROM (SELECT *, avg(gain) OVER (PARTITION BY tree_id, lod) AS mean, count(*) OVER (PARTITION BY tree_id, lod) AS n
         FROM {source}) c)"""


def _scored(t: Tables):
    return lambda nodes: nodes.withColumn("gain", t.gain())


@query(
    "w4_chosen_splits",
    f"""SELECT tree_id, lod, patch FROM {_CHOSEN.format(source="(SELECT g.* FROM gains g JOIN trees USING (tree_id, lod, patch) WHERE lod IN (3, 4))")}
        WHERE n > 1 AND place <= wanted""",
    "gains",
    "trees",
)
def _(t: Tables):
    rows = t.trees.filter(F.col("lod").isin(3, 4)).withColumn("gain", t.gain())
    chosen = tree.choose_splits(rows, "gain", {4: 1.5})
    return chosen.filter("chosen").select("tree_id", "lod", "patch")


@query(
    "w5_top_half",
    """SELECT tree_id, lod, patch FROM (SELECT g.*, row_number() OVER (PARTITION BY tree_id, lod ORDER BY gain DESC, patch) AS place,
         count(*) OVER (PARTITION BY tree_id, lod) AS n FROM gains g JOIN trees USING (tree_id, lod, patch) WHERE lod >= 3)
       WHERE place <= floor(n * 0.5)""",
    "gains",
    "trees",
)
def _(t: Tables):
    rows = t.trees.filter(F.col("lod") >= 3).withColumn("gain", t.gain())
    return tree.keep_top_half(rows, "gain").select("tree_id", "lod", "patch")


def _drops(t: Tables, nodes):
    inner = nodes.filter(F.col("lod").isin(3, 4))
    return inner.withColumn("drop", t.gain() + 0.5).select("tree_id", "lod", "patch", "drop")


@query(
    "w6_pruned_level",
    f"""SELECT t.tree_id, t.lod, t.patch FROM trees t LEFT JOIN gains g ON g.tree_id = t.tree_id AND g.lod = t.lod - 1
          AND g.patch = {parent("t.lod", "t.patch")}
        WHERE NOT (t.lod = 5 AND g.gain + 0.5 <= 0.2)""",
    "gains",
    "trees",
)
def _(t: Tables):
    return tree.prune(t.trees, _drops(t, t.trees), {4: 0.2})


@query(
    "q7_bottom_up_pruning",
    f"""WITH p4 AS (SELECT f.*, g.gain + 0.5 AS drop3 FROM gains f JOIN gains g ON g.tree_id = f.tree_id AND g.lod = 3
            AND f.lod = 4 AND g.patch = {parent("f.lod", "f.patch")}),
        p5 AS (SELECT f.*, p.drop3, p.gain + 0.5 AS drop4 FROM gains f JOIN p4 p ON p.tree_id = f.tree_id
            AND f.lod = 5 AND p.patch = {parent("f.lod", "f.patch")}),
        alive AS (SELECT tree_id, lod, patch FROM gains WHERE lod <= 3 UNION ALL
          SELECT tree_id, lod, patch FROM p4 WHERE drop3 > 0.3 UNION ALL
          SELECT tree_id, lod, patch FROM p5 WHERE drop3 > 0.3 AND drop4 > 0.2)
        SELECT tree_id, lod, count(*) AS n, {PATCHES} FROM alive GROUP BY tree_id, lod""",
    "gains",
)
def _(t: Tables):
    full = tree.complete_trees(t.tree_ids)
    drops = _drops(t, tree.complete_trees(t.tree_ids, 4))
    return _patches(tree.prune(full, drops), "tree_id", "lod")


_SEARCH = """WITH s3 AS (SELECT tree_id, patch FROM {c3} WHERE n > 1 AND place <= wanted),
   n4 AS (SELECT g.* FROM gains g JOIN s3 ON s3.tree_id = g.tree_id AND g.lod = 4 AND s3.patch = {p}),
   s4 AS (SELECT tree_id, patch FROM {c4} WHERE n > 1 AND place <= wanted),
   n5 AS (SELECT g.* FROM gains g JOIN s4 ON s4.tree_id = g.tree_id AND g.lod = 5 AND s4.patch = {p}),
   found AS (SELECT tree_id, lod, patch, idx FROM gains WHERE lod <= 3 UNION ALL
     SELECT tree_id, lod, patch, idx FROM n4 UNION ALL SELECT tree_id, lod, patch, idx FROM n5)
""".format(
    c3=_CHOSEN.format(source="(SELECT * FROM gains WHERE lod = 3)"),
    c4=_CHOSEN.format(source="n4"),
    p=parent("g.lod", "g.patch"),
)


@query(
    "q6_greedy_search",
    _SEARCH
    + f"SELECT tree_id, lod, count(*) AS n, {PATCHES} FROM found GROUP BY tree_id, lod",
    "gains",
)
def _(t: Tables):
    return _patches(tree.greedy_search(t.tree_ids, _scored(t), GUARANTEED_DEPTH, {4: 1.5}), "tree_id", "lod")


_PLACED = f""", placed AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY idx) - 1 AS pos FROM found),
    linked AS (SELECT a.*, coalesce(b.pos, -1) AS parent_pos FROM placed a LEFT JOIN placed b
      ON b.tree_id = a.tree_id AND b.lod = a.lod - 1 AND b.patch = {parent("a.lod", "a.patch")}),
    marks AS (SELECT g.tree_id, g.idx, CASE WHEN f.patch IS NOT NULL THEN 1 WHEN q.patch IS NOT NULL THEN 0 ELSE -1 END AS status
      FROM gains g LEFT JOIN found f ON f.tree_id = g.tree_id AND f.lod = g.lod AND f.patch = g.patch
      LEFT JOIN found q ON q.tree_id = g.tree_id AND q.lod = g.lod - 1 AND q.patch = {parent("g.lod", "g.patch")}),
    vectors AS (SELECT tree_id, string_agg(status::VARCHAR, ',' ORDER BY idx) AS status FROM marks GROUP BY tree_id)
    SELECT lpad(l.tree_id::VARCHAR, 10, '0') AS key, l.tree_id // 100 AS shard, (l.tree_id % 10)::BIGINT AS class_id,
      string_agg(((l.idx * 7 + l.tree_id) % 512)::VARCHAR, ',' ORDER BY pos) AS codes,
      string_agg(lod::VARCHAR, ',' ORDER BY pos) AS lods, string_agg(patch::VARCHAR, ',' ORDER BY pos) AS patches,
      string_agg(parent_pos::VARCHAR, ',' ORDER BY pos) AS parents, any_value(v.status) AS status
    FROM linked l JOIN vectors v USING (tree_id) GROUP BY l.tree_id"""


@query("d7_pretokenise", _SEARCH.replace("floor((sum", "floor((1.0 * sum") + _PLACED, "gains")
def _(t: Tables):
    """Search, pack, store as archives in the pretokenised form, and read back."""
    from tesserae.plans.jobs import pretokenised_samples

    def codes(lods, patches, tree_id):
        return F.transform(level_arrays.indices(lods, patches), lambda i: F.pmod(i * 7 + tree_id, F.lit(512)))

    found = pretokenised_samples(t.tree_ids, _scored(t), GUARANTEED_DEPTH, {4: 1.5})
    samples = found.select(
        F.lpad(F.col("tree_id").cast("string"), 10, "0").alias("key"),
        F.floor(F.col("tree_id") / 100).alias("shard"),
        F.pmod("tree_id", F.lit(10)).alias("class_id"),
        codes("lods", "patches", F.col("tree_id")).alias("codes"),
        "parents",
        "json",
    )
    path = scratch(t.spark, "pretokenised")
    token_io.write_tree_archives(samples, path, compressed=True)
    back = token_io.read_tree_archives(t.spark, path)
    texts = [joined(c).alias(c) for c in ("codes", "lods", "patches", "parents", "status")]
    return back.select("key", "shard", "class_id", *texts)


_ROLL = "WITH l5 AS (SELECT n.*, " + u("'value'", "tree_id", "patch") + " AS val FROM nodes n WHERE lod = 5)" + "".join(
    f""", l{k} AS (SELECT n.*, coalesce(m.val, 0) AS val FROM (SELECT * FROM nodes WHERE lod = {k}) n LEFT JOIN
        (SELECT tree_id, {parent(str(k + 1), "patch")} AS up, avg(val) AS val FROM l{k + 1} GROUP BY 1, 2) m
        ON m.tree_id = n.tree_id AND m.up = n.patch)"""
    for k in range(4, -1, -1)
)


@query(
    "q8_roll_up",
    _ROLL
    + " UNION ALL ".join(f" SELECT tree_id, lod, patch, {r('val')} AS val FROM l{k}" for k in range(6)),
    "nodes",
)
def _(t: Tables):
    nodes = t.trees.withColumn("val", uniform(F.lit("value"), "tree_id", "patch"))
    out = tree.roll_up(nodes, "val")
    return out.select("tree_id", "lod", "patch", rounded("val").alias("val"))


@query(
    "e2_removed_children",
    f"""SELECT tree_id, lod, patch FROM trees WHERE lod = 4 EXCEPT
        SELECT f.tree_id, f.lod, f.patch FROM trees f JOIN gains g ON g.tree_id = f.tree_id AND g.lod = 3 AND f.lod = 4
          AND g.patch = {parent("f.lod", "f.patch")} WHERE g.gain < 0""",
    "gains",
    "trees",
)
def _(t: Tables):
    poor = tree.nodes_at_level(t.trees, 3).filter(t.gain() < 0)
    return tree.removed_children(tree.nodes_at_level(t.trees, 4), poor)


@query(
    "f2_flatten",
    """SELECT tree_id, string_agg(lod::VARCHAR, ',' ORDER BY idx) AS lods,
         string_agg(patch::VARCHAR, ',' ORDER BY idx) AS patches FROM nodes GROUP BY tree_id""",
    "nodes",
)
def _(t: Tables):
    flat = sequences.flatten_nodes(tree.ordered(t.trees))
    return flat.select("tree_id", joined("lods").alias("lods"), joined("patches").alias("patches"))


@query(
    "f3_json_round_trip",
    f"""SELECT s.tree_id, s.status, n.lods, n.patches FROM
          (SELECT tree_id, {_STATUS_TEXT} AS status FROM node_status GROUP BY tree_id) s JOIN
          (SELECT tree_id, string_agg(lod::VARCHAR, ',' ORDER BY idx) AS lods,
             string_agg(patch::VARCHAR, ',' ORDER BY idx) AS patches FROM nodes GROUP BY tree_id) n USING (tree_id)""",
    "node_status",
    "nodes",
)
def _(t: Tables):
    back = level_arrays.from_json(level_arrays.to_json(level_arrays.packed(t.trees)))
    return back.select("tree_id", *[joined(c).alias(c) for c in ("status", "lods", "patches")])


@query(
    "f3_status_to_nodes",
    f"""SELECT tree_id, lod, status, count(*) AS n, {PATCHES} FROM node_status WHERE status >= 0
        GROUP BY tree_id, lod, status""",
    "node_status",
)
def _(t: Tables):
    back = level_arrays.from_json(level_arrays.to_json(level_arrays.packed(t.trees)))
    return _patches(level_arrays.of_status(back), "tree_id", "lod", "status")


@query(
    "f4_patch_arithmetic",
    f"""SELECT DISTINCT lod, patch, patch // (1 << lod::INT) AS row, patch % (1 << lod::INT) AS col,
          CASE WHEN lod > 0 THEN {parent("lod", "patch")} END AS parent,
          CASE WHEN lod < 5 THEN (patch // (1 << lod::INT)) * 2 * (2 << lod::INT) + (patch % (1 << lod::INT)) * 2 END AS child0,
          CASE WHEN lod < 5 THEN ((patch // (1 << lod::INT)) * 2 + 1) * (2 << lod::INT) + (patch % (1 << lod::INT)) * 2 + 1 END AS child3
        FROM trees""",
    "trees",
)
def _(t: Tables):
    side = geo.by_level("lod", geo.SIDES)
    nodes = t.trees.select("lod", "patch").distinct()
    below = geo.child_patches("lod", "patch")
    inner = F.col("lod") < len(geo.SIDES) - 1
    return nodes.select(
        "lod",
        "patch",
        geo.cell_row("patch", side).alias("row"),
        geo.cell_col("patch", side).alias("col"),
        geo.parent_patch("lod", "patch").alias("parent"),
        F.when(inner, below[0]).alias("child0"),
        F.when(inner, below[3]).alias("child3"),
    )


# Patch size per level of the fixed-tree configuration, and its resolution.
PATCH_SIZES = (16, 16, 16, 16, 16, 8)
RESOLUTION = 256


@query(
    "f11_node_boxes",
    f"""SELECT DISTINCT lod, patch, {r("x / 256.0::DOUBLE")} AS x0, {r("y / 256.0::DOUBLE")} AS y0,
          {r("(x + s) / 256.0::DOUBLE")} AS x1, {r("(y + s) / 256.0::DOUBLE")} AS y1
        FROM (SELECT lod, patch, CASE WHEN lod = 5 THEN 8 ELSE 16 END AS s,
                (patch % (1 << lod::INT)) * CASE WHEN lod = 5 THEN 8 ELSE 16 END AS x,
                (patch // (1 << lod::INT)) * CASE WHEN lod = 5 THEN 8 ELSE 16 END AS y FROM trees)""",
    "trees",
)
def _(t: Tables):
    nodes = t.trees.select("lod", "patch").distinct()
    box = geo.node_box("lod", "patch", PATCH_SIZES, RESOLUTION)
    return nodes.select("lod", "patch", *[rounded(c).alias(n) for n, c in box.items()])
