"""Mix sources to target weights by capped water-filling.

All sources share the total size by weight. A source whose share is above its cap (its size
times the largest number of epochs) is clamped there, and the excess goes to the others in
proportion to their weights until no source is above its cap. A document is then repeated
``floor(target / size of its source)`` times, and a seeded sample fills up the fraction.

Water-filling is solved in closed form: in the order of cap / weight the clamped sources come
first, so running sums over the table of sources, one row each, find the common level; they go
by slices, so sources may be as many as hosts. The sample takes documents in the order of a
seeded hash until the fraction is reached, to within one document. Sums per source and hash bin
find the one bin in which that happens; only the rows of that bin (1 in 4096) are put in order.
Null and repeated ids share a hash, so such a bin can hold a whole source: above ``HOT_ROWS``
rows it is sliced over many tasks too.

Defined cases: a null text has size 0; sources order by code point with null last, a source
of its own; documents of size 0 are taken 0 words; equal rows share a hash and are taken one
by one; a source without words has target 0; an empty table gives an empty table; columns
named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.names import fresh
from tesserae.operators.ordering import HOT_ROWS, number_rows, running_totals
from tesserae.session import materialise

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Bits of the hash that make a bin.
BIN_BITS = 12


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, however many there are."""
    ranked = number_rows(sizes, [], [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_weight": weight, "_cap": F.col("source_size") * max_epochs})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    placed = materialise(running_totals(ranked, [], ["_ratio", "_rank"], {"_caps": "_cap", "_weights": "_weight"}))
    every = placed.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    # The level that the sources from this one on would share if all before it were clamped.
    level = (F.lit(every["size"]) - (F.col("_caps") - F.col("_cap"))) / (F.lit(every["weight"]) - (F.col("_weights") - F.col("_weight")))
    fits = placed.withColumn("_level", level).filter(F.col("_ratio") >= F.col("_level"))
    first = fits.agg(F.min(F.struct("_ratio", "_rank", "_level")).alias("f")).first()["f"]
    cap = F.col("_cap").cast("double")
    if first is None:
        return placed.select("source", "source_size", cap.alias("target"))
    clamped = (F.col("_ratio") < first["_ratio"]) | ((F.col("_ratio") == first["_ratio"]) & (F.col("_rank") < first["_rank"]))
    target = F.when(clamped, cap).otherwise(F.least(F.col("_weight") * F.lit(first["_level"]), cap))
    return placed.select("source", "source_size", target.alias("target"))


def _edge_totals(rows: DataFrame, order: list[Column], name: str, any_hot: bool, hot: Column, hot_rows: int) -> DataFrame:
    """Add the words of the rows of a source up to each row. Bins above ``hot_rows`` go by slices."""
    upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not any_hot:
        return rows.withColumn(name, F.sum("size").over(upto))
    held = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("held")
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    many = rows.filter(hot).select(held, "source", "size", *keys)
    many = running_totals(many, ["source"], [f"k{i}" for i in range(len(order))], {"upto": "size"}, hot_rows)
    return rows.filter(~hot).withColumn(name, F.sum("size").over(upto)).unionByName(
        many.select("held.*", F.col("upto").alias(name))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    bin_bits: int = BIN_BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``source_size``, ``target``, ``times`` and ``taken`` to rows with ``doc_id``, ``source`` and ``size``."""
    docs = docs.drop("source_size", "target", "times", "taken")
    draw, part, edge, start, need, whole, run, key = (
        fresh(docs, n) for n in ("draw", "part", "edge", "start", "need", "whole", "run", "source_key")
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_epochs)
    plan = plan.withColumn(
        whole,
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0),
    ).withColumn(need, F.greatest(F.col("target") - F.col(whole) * F.col("source_size"), F.lit(0.0)))

    head = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))), 1, 8)
    drawn = docs.withColumn(draw, F.conv(head, 16, 10).cast("bigint"))
    drawn = drawn.withColumn(part, F.shiftright(draw, 32 - bin_bits))

    bins = drawn.groupBy("source", part).agg(F.sum("size").alias(run), F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn(start, F.sum(run).over(upto))
    bins = bins.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).filter(F.col(start) > F.col(need))
    edges = bins.groupBy(F.col("b.source").alias(key)).agg(
        F.min(F.struct(F.col(part).alias("bin"), (F.col(start) - F.col(run)).alias("sum"), "rows")).alias(edge)
    )
    plan = plan.join(edges, plan["source"].eqNullSafe(edges[key]), "left").drop(key)
    # Stored, its size is known: a table of one row per source is then sent to the tasks when it
    # is below Spark's own limit for that, and no row of a hot source moves.
    plan = materialise(plan.withColumnRenamed("source", key))
    rows = drawn.join(plan, drawn["source"].eqNullSafe(plan[key])).drop(key)

    inside = F.col(part) == F.col(f"{edge}.bin")
    taken_rows = rows.filter(F.coalesce(~inside, F.lit(True))).withColumn(
        "times", F.col(whole) + F.when(F.coalesce(F.col(part) < F.col(f"{edge}.bin"), F.lit(True)), 1).otherwise(0)
    )
    # Rows that share an id are told apart by all their columns, so that reruns take the same ones.
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = [F.col(draw), F.col("doc_id"), F.col("size"), F.xxhash64(*plain)]
    hot = F.col(f"{edge}.rows") > hot_rows
    edge_rows = _edge_totals(rows.filter(inside), order, run, not plan.filter(hot).isEmpty(), hot, hot_rows)
    edge_rows = edge_rows.withColumn(run, F.col(f"{edge}.sum") + F.col(run) - F.col("size") / 2)
    edge_rows = edge_rows.withColumn("times", F.col(whole) + F.when(F.col(run) <= F.col(need), 1).otherwise(0)).drop(run)
    out = taken_rows.unionByName(edge_rows)
    # A source at its cap has no fraction left, whatever the rounding of its target.
    out = out.withColumn("times", F.least(F.col("times"), F.lit(max_epochs)).cast("bigint"))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop(draw, part, edge, need, whole)


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``times`` says."""
    one = fresh(mixed, "copy")
    rows = mixed.filter("times > 0").withColumn(one, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.drop(one)


def mixed_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with their columns.

    Sizes per source and bin are aggregated first; whole rows meet only one row per source.
    """
    size = fresh(docs, "size")
    rows = docs.withColumn(size, texts.word_count(F.col(f"`{text}`").cast("string")))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = rows.select(held, F.col("doc_id"), F.col("source"), F.col(size).alias("size"))
    return repeat(mix(packed)).select("row.*")
