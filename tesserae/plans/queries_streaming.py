"""Queries that run a stream to the end of its input and return what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.core import rounded
from tesserae.functions.vectors import softmax
from tesserae.operators import dataset, quality
from tesserae.operators.neighbours import codebook_products
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r
from tesserae.plans.views import CODEBOOK_SIZE, Tables
from tesserae.session import broadcast_if_small
from tesserae.sources import archive
from tesserae.streaming import metrics, run


def _stream(t: Tables, table: str) -> DataFrame:
    # A table is one file or a folder of them. Spark streams from both when the path is a pattern.
    return run.file_stream(t.spark, f"{t.folder}/{table}.parque[t]", "*", t.table(table).schema)


def _updated(t: Tables, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path = run.work_dir(t.spark, name)
    run.update_table(stream, path, f"{path}-checkpoint", keys)
    return run.current(t.spark, path, keys)


@query(
    "t1_incremental_ingest",
    """SELECT doc_id // 20 AS shard, lpad(doc_id::VARCHAR, 8, '0') AS key, md5(text) AS digest FROM documents""",
)
def _(t: Tables):
    docs = _stream(t, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("shard"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"),
        F.md5("text").alias("digest"),
    )
    path = run.work_dir(t.spark, "ingest")
    # The second run finds nothing new: every file is taken once.
    run.append_to_table(docs, path, f"{path}-checkpoint")
    run.append_to_table(docs, path, f"{path}-checkpoint")
    return t.spark.read.parquet(path)


@query(
    "t1_archive_stream",
    """SELECT doc_id // 20 AS shard, lpad(doc_id::VARCHAR, 8, '0') AS key, md5(text) AS digest, lang AS label FROM documents""",
)
def _(t: Tables):
    """Archives that arrive in two lots, streamed sample by sample over two runs of the query."""
    columns = {"txt": "text", "cls": "lang"}
    docs = t.table("documents").select(
        F.floor(F.col("doc_id") / 20).alias("shard"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"),
        archive.text_payload("text").alias("text"),
        archive.text_payload("lang").alias("lang"),
    )
    rows = docs.select("shard", "key", archive.members_of(columns).alias("members"))
    folder = run.work_dir(t.spark, "arriving")
    out, ledger, checkpoint = f"{folder}-out", f"{folder}-ledger", f"{folder}-checkpoint"
    for lot in (0, 1):
        archive.write_sample_rows(rows.filter(F.col("shard") % 2 == lot), folder, f"lot{lot}")
        stream = run.shard_stream(t.spark, folder, ledger, "samples")
        wide = archive.sample_columns(stream, columns)
        named = wide.select("shard", "key", F.md5("text").alias("digest"), archive.payload_text("lang").alias("label"))
        run.append_to_table(named, out, checkpoint)
    return t.spark.read.parquet(out)


@query(
    "t2_relabel_in_flight",
    """SELECT s_suppkey AS key, n_nationkey::BIGINT AS idx FROM supplier
       JOIN nation ON n_name = CASE WHEN s_suppkey % 13 = 0 THEN 'unknown'
         ELSE (SELECT m.n_name FROM nation m WHERE m.n_nationkey = s_nationkey) END""",
)
def _(t: Tables):
    names = t.table("nation").select("n_nationkey", "n_name")
    rows = _stream(t, "supplier").join(broadcast_if_small(names), F.col("s_nationkey") == F.col("n_nationkey"))
    unknown = F.col("s_suppkey") % 13 == 0
    rows = rows.select(
        F.col("s_suppkey").alias("key"),
        F.when(unknown, F.lit("unknown")).otherwise(F.col("n_name")).alias("label_str"),
    )
    looked = dataset.look_up(rows, t.dictionary, "label_str", "name", "idx")
    known, _ = dataset.known_only(looked, "idx")
    path = run.work_dir(t.spark, "relabel")
    run.append_to_table(known.select("key", "idx"), path, f"{path}-checkpoint")
    return t.spark.read.parquet(path)


@query(
    "t3_online_codebook",
    f"""WITH counts AS (SELECT l_partkey % 500 AS code, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT count(*) AS used, count(*) / 512.0::DOUBLE AS usage,
          {r("sum(-(n / total) * log2(n / total + 1e-8))")} AS entropy,
          CASE WHEN count(*) < 512 THEN 0 ELSE min(n) END AS min_freq, max(n) AS max_freq
        FROM (SELECT n, sum(n) OVER ()::DOUBLE AS total FROM counts)""",
)
def _(t: Tables):
    codes = _stream(t, "lineitem").select((F.col("l_partkey") % 500).alias("code"))
    counts = _updated(t, metrics.code_counts(codes), "codes", ["code"])
    return metrics.code_metrics(counts, CODEBOOK_SIZE).withColumn("entropy", rounded("entropy"))


@query(
    "t3_online_inception_score",
    f"""SELECT {r("exp(sum((k - s * ln(s / n + 1e-16)) / n))", 4)} AS score FROM (
          SELECT class, count(*) AS n, sum(p) AS s, sum(p * ln(p + 1e-16)) AS k FROM probs GROUP BY class)""",
    "probs",
)
def _(t: Tables):
    vectors = _stream(t, "embeddings").select(F.transform("embedding", lambda e: e.cast("double")).alias("v"))
    scored = codebook_products(vectors, t.codebook, "v", "logits", scale=10.0)
    probs = scored.select(F.posexplode(softmax("logits")).alias("class", "p"))
    sums = _updated(t, metrics.class_sums(probs), "classes", ["class"])
    return metrics.inception_from_sums(sums).withColumn("score", rounded("score", 4))


@query(
    "t3_online_covariance",
    f"""WITH m AS (SELECT p, avg(v) AS mean FROM vec GROUP BY p)
        SELECT a.p AS i, b.p AS j, {r("any_value(ma.mean)")} AS mean,
          {r("sum((a.v - ma.mean) * (b.v - mb.mean)) / (count(*) - 1)")} AS cov
        FROM vec a JOIN vec b USING (image_id) JOIN m ma ON ma.p = a.p JOIN m mb ON mb.p = b.p GROUP BY a.p, b.p""",
    "vec",
)
def _(t: Tables):
    """The vectors arrive in five files, two a batch, and are merged into one state."""
    parts = run.work_dir(t.spark, "vectors")
    t.vectors.select("v").repartition(5).write.parquet(parts)
    stream = run.file_stream(t.spark, parts, "*.parquet", t.spark.read.parquet(parts).schema, files_per_trigger=2)
    metrics.online_moments(stream, "v", f"{parts}-state", f"{parts}-checkpoint")
    out = quality.covariance(metrics.current_moments(t.spark, f"{parts}-state"))
    return out.select("i", "j", rounded("mean").alias("mean"), rounded("cov").alias("cov"))


@query(
    "t4_tumbling_throughput",
    f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, {r("sum(value)", 4)} AS total
        FROM events GROUP BY 1""",
)
def _(t: Tables):
    out = metrics.throughput(_stream(t, "events"), "ts", "value", "1 hour")
    rows = _updated(t, out, "tumbling", ["start"])
    return rows.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", rounded("total", 4).alias("total")
    )


@query(
    "t4_sliding_throughput",
    f"""SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k), '%Y-%m-%d %H:%M') AS start, count(*) AS n,
          {r("sum(value)", 4)} AS total FROM events, (VALUES (0), (1)) s(k) GROUP BY 1""",
)
def _(t: Tables):
    out = metrics.throughput(_stream(t, "events"), "ts", "value", "1 hour", "30 minutes")
    rows = _updated(t, out, "sliding", ["start"])
    return rows.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", rounded("total", 4).alias("total")
    )


@query(
    "t5_latest_status",
    """SELECT run, event_id, status FROM (SELECT user_id AS run, event_id, event_type AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def _(t: Tables):
    rows = _stream(t, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        F.col("event_type").alias("status"),
        F.date_trunc("day", "ts").alias("modified"),
    )
    out = metrics.latest_status(rows, "run", "modified", "event_id", ["event_id", "status"])
    return _updated(t, out, "status", ["run"])
