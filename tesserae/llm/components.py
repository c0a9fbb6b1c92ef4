"""Connected components of a link table, by alternating star contractions.

Each round points every node at the least node it knows of, first for larger and then for
smaller neighbours, until nothing changes; the number of rounds grows with the logarithm of
the longest chain. Least neighbours come from aggregations that combine before the shuffle
and a join, so a hub with any number of links is not gathered in one place. Every round is
written to the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def roots(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): every linked node and the least node of its component.

    Links with a null end and links to oneself are ignored.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    mark = None
    while True:
        links = materialise(_small_star(_large_star(links)).distinct())
        # A fixed point keeps its links: their number and hashed sum stay the same.
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(links.agg(F.count(F.lit(1)), total).first())
        if now[0] == 0 or mark == now:
            break
        mark = now
    # Every root is an end, every other node a beginning, of a link.
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends)
