"""Queries over integrity checks, job status and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.core import rounded
from tesserae.operators import status
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r
from tesserae.plans.views import Tables, log_text
from tesserae.sources import logs

_REQUIRED_SQL = "(VALUES (0, 'code_indices.npy'), (1, 'patch_indices.npy'), (2, 'lod_indices.npy'), (3, 'cls')) q(place, ext)"
_MISSING = f"""WITH miss AS (SELECT d.shard, d.key, q.place, q.ext FROM docs d, {_REQUIRED_SQL}
    WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.shard = d.shard AND m.key = d.key AND m.ext = q.ext))
"""
_VERDICT = (
    _MISSING
    + """, manifest AS (SELECT DISTINCT page_id // 4 AS shard FROM pages UNION SELECT DISTINCT shard FROM docs),
     s AS (SELECT shard, count(*) AS samples FROM docs GROUP BY shard),
     f AS (SELECT shard, count(*) AS misses, min(key || '|' || place::VARCHAR) AS first FROM miss GROUP BY shard),
     verdict AS (SELECT m.shard, CASE WHEN s.samples IS NULL THEN 'empty' WHEN f.misses > 0 THEN 'incomplete'
           ELSE 'ok' END AS status, coalesce(s.samples, 0) AS samples, coalesce(f.misses, 0) AS misses,
         split_part(f.first, '|', 1) AS first_key,
         (SELECT q.ext FROM """
    + _REQUIRED_SQL
    + """ WHERE q.place::VARCHAR = split_part(f.first, '|', 2)) AS first_ext
       FROM manifest m LEFT JOIN s USING (shard) LEFT JOIN f USING (shard))
"""
)


def _manifest(t: Tables):
    pages = t.table("pages").select(F.floor(F.col("page_id") / 4).alias("shard"))
    return pages.unionByName(t.documents_by_shard.select("shard")).distinct()


def _verdicts(t: Tables):
    return status.shard_verdicts(_manifest(t), t.members)


@query("j14_missing_components", _MISSING + "SELECT shard, key, place, ext FROM miss", "members")
def _(t: Tables):
    return status.missing_components(t.members)


@query("d4_shard_verdicts", _VERDICT + "SELECT * FROM verdict", "members")
def _(t: Tables):
    return _verdicts(t)


@query(
    "a19_status_summary",
    _VERDICT
    + """SELECT status, count(*) AS shards, sum(samples)::BIGINT AS samples FROM verdict GROUP BY ROLLUP (status)""",
    "members",
)
def _(t: Tables):
    return status.status_summary(_verdicts(t))


@query(
    "s8_report_lines",
    _VERDICT
    + """, lines AS (SELECT 1 AS section, shard, '[' || lpad(shard::VARCHAR, 6, '0') || '] ' ||
           CASE WHEN status = 'ok' THEN 'ok, samples: ' || samples::VARCHAR
                ELSE 'error: ' || concat_ws(' ', first_key, first_ext) END AS text FROM verdict
         UNION ALL SELECT 2, NULL, coalesce(status, 'all') || ': ' || count(*)::VARCHAR || ' shards, '
           || sum(samples)::VARCHAR || ' samples' FROM verdict GROUP BY ROLLUP (status)
         UNION ALL SELECT 3, shard, shard::VARCHAR FROM verdict WHERE status <> 'ok')
       SELECT * FROM lines""",
    "members",
)
def _(t: Tables):
    return status.report_lines(_verdicts(t))


@query(
    "j15_work_plan",
    """SELECT m.shard, CASE WHEN d.shard IS NULL THEN 'not_found' WHEN e.shard IS NOT NULL THEN 'exists'
         ELSE 'todo' END AS plan
       FROM (SELECT DISTINCT page_id // 4 AS shard FROM pages UNION SELECT DISTINCT shard FROM docs) m
       LEFT JOIN (SELECT DISTINCT shard FROM docs) d USING (shard)
       LEFT JOIN (SELECT DISTINCT vec_id // 20 AS shard FROM embeddings) e USING (shard)""",
    "docs",
)
def _(t: Tables):
    done = t.table("embeddings").select(F.floor(F.col("vec_id") / 20).alias("shard"))
    return status.work_plan(_manifest(t), t.documents_by_shard, done)


@query(
    "d5_progress_summary",
    """SELECT status, count(*) AS lines, count(DISTINCT user_id) AS shards
       FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED'
               ELSE 'SUCCESS' END AS status FROM events) GROUP BY ROLLUP (status)""",
)
def _(t: Tables):
    word = (
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "SKIPPED").otherwise("SUCCESS")
    )
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), word, F.lit(": shard "),
        F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(" done"),
    )
    rows = logs.parse_progress_log(t.table("events").select(line.alias("line")))
    return rows.rollup("status").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("shard").alias("shards")
    )


@query(
    "w1_latest_result",
    """SELECT run, event_id, status FROM (SELECT user_id AS run, event_id, event_type AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def _(t: Tables):
    rows = t.table("events").select(
        F.col("user_id").alias("run"),
        "event_id",
        F.col("event_type").alias("status"),
        F.date_trunc("day", "ts").alias("modified"),
    )
    return status.latest(rows, "run", "modified", "event_id", ["event_id", "status"])


@query(
    "w9_checkpoints_to_delete",
    """SELECT run, name, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, name) AS rn
         FROM (SELECT user_id AS run, CASE WHEN event_type = 'error' THEN 'checkpoint-' || event_id::VARCHAR || 'x'
                 ELSE 'checkpoint-' || event_id::VARCHAR END AS name,
               CASE WHEN event_type = 'error' THEN -1 ELSE event_id END AS step FROM events)) WHERE rn > 5""",
)
def _(t: Tables):
    tail = F.when(F.col("event_type") == "error", "x").otherwise("")
    name = F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string"), tail)
    rows = t.table("events").select(F.col("user_id").alias("run"), name.alias("name"))
    return status.checkpoints_to_delete(rows, "run", "name", 5)


_PARSED = """SELECT run, stamp, 'train' AS name, (event_id % 10000) / 10000.0::DOUBLE AS data_time,
    cents / 100.0::DOUBLE AS rate, (event_id * 7 % 10000) / 10000.0::DOUBLE AS batch_time, 0.0001::DOUBLE AS lr,
    event_id AS step, 6 + (event_id * 13 % 10000) / 10000.0::DOUBLE AS loss FROM log_cols"""


def _parsed(t: Tables):
    return logs.parse_training_log(t.log_lines.select("run", "line"))


@query("s7_training_log", _PARSED, "log_cols")
def _(t: Tables):
    return _parsed(t).drop("token_acc")


@query(
    "w13_meter",
    f"""SELECT run, step // 50 AS block, max_by(rate, step) AS last, {r("sum(rate)")} AS total, count(*) AS n,
          {r("avg(rate)")} AS average FROM ({_PARSED}) GROUP BY run, step // 50""",
    "log_cols",
)
def _(t: Tables):
    rows = _parsed(t).withColumn("step", F.col("step") + 1)
    out = status.meter(rows, "run", "step", F.col("rate"), 50)
    return out.withColumn("total", rounded("total")).withColumn("average", rounded("average"))


@query(
    "f8_log_timestamps",
    """SELECT user_id AS run, event_id,
         strftime(ts + to_hours(event_id::INT), '%m/%d %H:%M:%S') AS stamp,
         strftime(ts + to_hours(event_id::INT), '%Y-%m-%d %H:%M:%S') AS at FROM events""",
)
def _(t: Tables):
    later = t.table("events").withColumn("ts", F.expr("ts + make_dt_interval(0, cast(event_id as int))"))
    rows = log_text(later)
    stamped = rows.select("run", "event_id", F.substring("line", 2, 14).alias("stamp"))
    out = status.with_year(stamped, "run", "event_id", "stamp", 2024)
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "s6_nested_json",
    """SELECT event_id, 'k' AS name, json_extract_string(props, '$.k')::BIGINT AS value FROM events""",
)
def _(t: Tables):
    parsed = F.from_json("props", "map<string, bigint>")
    return t.table("events").select("event_id", F.explode(parsed).alias("name", "value"))


@query(
    "s7_check_logs",
    """SELECT o_orderkey AS shard,
         CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'error' ELSE 'unknown' END AS status,
         CASE o_orderstatus WHEN 'O' THEN o_custkey ELSE 0 END AS samples,
         CASE o_orderstatus WHEN 'F' THEN 'record ' || o_custkey::VARCHAR || ' is cut' END AS error
       FROM orders""",
)
def _(t: Tables):
    number, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    good = F.concat(F.lit("✅ 文件 "), number, F.lit(" 正常，共 "), customer, F.lit(" 个样本\n"))
    bad = F.concat(F.lit("❌ 文件 "), number, F.lit(": 错误 - record "), customer, F.lit(" is cut\nend\n"))
    body = F.when(F.col("o_orderstatus") == "O", good).when(F.col("o_orderstatus") == "F", bad).otherwise("")
    files = t.table("orders").select(F.concat(F.lit("文件索引: "), number, F.lit("\n"), body).alias("content"))
    return logs.parse_check_logs(files)
