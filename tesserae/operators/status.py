"""Integrity verdicts, job status, reports, and housekeeping plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ordering import number_rows, running_totals
from tesserae.session import broadcast_if_small

# The members a complete token sample has, in checking order.
REQUIRED = ("code_indices.npy", "patch_indices.npy", "lod_indices.npy", "cls")


def missing_components(members: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(shard, key, place, ext): every required member a sample lacks.

    Presence is reduced to one flag per required member before the shuffle, so neither a
    cross join with the required list nor an anti-join is needed.
    """
    flags = [F.max((F.col("ext") == e).cast("int")).alias(f"_{i}") for i, e in enumerate(required)]
    found = members.groupBy("shard", "key").agg(*flags)
    gaps = F.array(
        *[
            F.when(F.col(f"_{i}") == 0, F.struct(F.lit(i).alias("place"), F.lit(e).alias("ext")))
            for i, e in enumerate(required)
        ]
    )
    rows = found.select("shard", "key", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g"))
    return rows.select("shard", "key", "g.place", "g.ext")


def shard_verdicts(
    manifest: DataFrame, members: DataFrame, required: Sequence[str] = REQUIRED
) -> DataFrame:
    """(shard, status, samples, misses, first_key, first_ext) for every shard of the manifest.

    ``status`` is ``ok``, ``incomplete`` or ``empty``. All misses are counted; their list is
    :func:`missing_components`.
    """
    flags = [F.max((F.col("ext") == e).cast("int")) for e in required]
    gaps = F.array(*[F.when(f == 0, F.lit(i)) for i, f in enumerate(flags)])
    per_key = members.groupBy("shard", "key").agg(F.filter(gaps, lambda g: g.isNotNull()).alias("gaps"))
    first = F.when(F.size("gaps") > 0, F.struct("key", F.col("gaps")[0].alias("place")))
    per_shard = per_key.groupBy("shard").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.size("gaps")).alias("misses"), F.min(first).alias("first")
    )
    rows = manifest.select("shard").distinct().join(per_shard, "shard", "left")
    status = (
        F.when(F.col("samples").isNull(), "empty").when(F.col("misses") > 0, "incomplete").otherwise("ok")
    )
    names = F.array(*[F.lit(e) for e in required])
    return rows.select(
        "shard",
        status.alias("status"),
        F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("misses", F.lit(0)).alias("misses"),
        F.col("first.key").alias("first_key"),
        F.try_element_at(names, F.col("first.place") + 1).alias("first_ext"),
    )


def work_plan(wanted: DataFrame, inputs: DataFrame, done: DataFrame) -> DataFrame:
    """(shard, plan): ``not_found`` without an input, ``exists`` when done, else ``todo``."""
    have = broadcast_if_small(inputs.select("shard").distinct().withColumn("_in", F.lit(True)))
    out = broadcast_if_small(done.select("shard").distinct().withColumn("_out", F.lit(True)))
    rows = wanted.select("shard").distinct().join(have, "shard", "left").join(out, "shard", "left")
    plan = F.when(F.col("_in").isNull(), "not_found").when(F.col("_out"), "exists").otherwise("todo")
    return rows.select("shard", plan.alias("plan"))


def status_summary(verdicts: DataFrame) -> DataFrame:
    """(status, shards, samples) per status, and one total row with a NULL status."""
    return verdicts.rollup("status").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("samples").alias("samples")
    )


def report_lines(verdicts: DataFrame) -> DataFrame:
    """(section, shard, text): one line per shard, then the totals and the bad shards."""
    name = F.concat(F.lit("["), F.lpad(F.col("shard").cast("string"), 6, "0"), F.lit("] "))
    ok = F.col("status") == "ok"
    good = F.concat(name, F.lit("ok, samples: "), F.col("samples").cast("string"))
    bad = F.concat(
        name, F.lit("error: "), F.coalesce(F.concat_ws(" ", "first_key", "first_ext"), F.lit("")),
    )
    detail = verdicts.select(F.lit(1).alias("section"), "shard", F.when(ok, good).otherwise(bad).alias("text"))
    totals = status_summary(verdicts).select(
        F.lit(2).alias("section"),
        F.lit(None).cast("bigint").alias("shard"),
        F.concat(
            F.coalesce("status", F.lit("all")),
            F.lit(": "),
            F.col("shards").cast("string"),
            F.lit(" shards, "),
            F.col("samples").cast("string"),
            F.lit(" samples"),
        ).alias("text"),
    )
    bad_ids = verdicts.filter(~ok).select(
        F.lit(3).alias("section"), "shard", F.col("shard").cast("string").alias("text")
    )
    return detail.unionByName(totals).unionByName(bad_ids)


def write_report(lines: DataFrame, path: str) -> None:
    """Store report lines as JSON, ordered by section and shard."""
    lines.orderBy("section", "shard").write.mode("overwrite").json(path)


def latest(results: DataFrame, key: str, modified: str, first: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per key; among equally new rows the one with the lowest ``first`` wins.

    An aggregate with map-side combine, not a window: a key with very many rows is fine.
    """
    row = F.struct(*columns)
    rank = F.struct(F.col(modified), -F.col(first))
    picked = results.groupBy(key).agg(F.max_by(row, rank).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def checkpoint_step(name: str | Column) -> Column:
    """Step number at the end of a checkpoint name, -1 when there is none."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.element_at(F.split(name, "-"), -1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def checkpoints_to_delete(names: DataFrame, run: str, name: str, keep: int) -> DataFrame:
    """All but the newest ``keep`` checkpoints of every run.

    The kept set is a small top-n (limited before the shuffle); the rest is what an
    anti-join leaves.
    """
    rows = names.withColumn("step", checkpoint_step(name))
    newest = Window.partitionBy(run).orderBy(F.desc("step"), F.col(name))
    kept = rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep)
    return rows.join(kept.select(run, name), [run, name], "left_anti")


def newest_checkpoint(names: DataFrame, run: str, name: str) -> DataFrame:
    rows = names.withColumn("step", checkpoint_step(name))
    return rows.groupBy(run).agg(
        F.max_by(name, "step").alias(name), F.max("step").alias("step")
    )


def meter(rows: DataFrame, run: str, step: str, value: Column, log_every: int) -> DataFrame:
    """(run, block, last, total, n, average) per logging interval of ``log_every`` steps."""
    block = F.floor((F.col(step) - 1) / F.lit(log_every)).alias("block")
    return rows.groupBy(run, block).agg(
        F.max_by(value, F.col(step)).alias("last"),
        F.sum(value).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("average"),
    )


def with_year(
    lines: DataFrame, run: str, order: str, stamp: str, start_year: int, name: str = "at"
) -> DataFrame:
    """Turn ``MM/dd HH:mm:ss`` stamps into timestamps.

    The first line of a run is in ``start_year``; the year advances whenever a stamp is
    smaller than the one before it in the same run.
    """
    rows = number_rows(lines, [run], [order], "_n")
    text, none = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    own = F.struct(F.col("_n").alias("_at"), F.col(order).alias("_o"), F.col(stamp).alias("_s"), text.alias("_p"))
    following = F.struct((F.col("_n") + 1).alias("_at"), none.alias("_o"), text.alias("_s"), F.col(stamp).alias("_p"))
    # Each stamp also goes to the next line, which is one shuffle and no self-join.
    sent = rows.select(run, F.explode(F.array(own, following)).alias("_r")).select(run, "_r.*")
    joined = sent.groupBy(run, "_at").agg(
        F.max("_o").alias(order), F.max("_s").alias(stamp), F.max("_p").alias("_before")
    )
    turn = F.coalesce((F.col(stamp) < F.col("_before")).cast("int"), F.lit(0))
    joined = joined.filter(F.col(stamp).isNotNull()).withColumn("_turn", turn)
    out = running_totals(joined, [run], ["_at"], {"_turns": "_turn"})
    year = (F.col("_turns") + start_year).cast("string")
    at = F.try_to_timestamp(F.concat_ws("/", year, F.col(stamp)), F.lit("yyyy/MM/dd HH:mm:ss"))
    return out.select(run, order, stamp, at.alias(name))
