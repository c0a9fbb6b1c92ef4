"""Typed rows from log text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import CHECK_LOG_NAME, LOG_LINE, metric


def parse_training_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add (stamp, name, data_time, rate, batch_time, lr, step, loss, token_acc).

    Lines of any other kind are dropped.
    """
    rows = lines.filter(F.col(line).rlike(LOG_LINE))

    def group(i: int):
        return F.regexp_extract(line, LOG_LINE, i)

    return rows.select(
        *[c for c in lines.columns if c != line],
        group(1).alias("stamp"),
        group(2).alias("name"),
        group(3).cast("double").alias("data_time"),
        group(4).cast("double").alias("rate"),
        group(5).cast("double").alias("batch_time"),
        group(6).cast("double").alias("lr"),
        group(7).cast("bigint").alias("step"),
        F.coalesce(metric(line, "Total Loss"), metric(line, "Loss")).alias("loss"),
        metric(line, "Token Acc").alias("token_acc"),
    )


def parse_check_names(files: DataFrame, file: str = "file") -> DataFrame:
    """Add (task_id, shard) from check log names; other files are dropped."""
    rows = files.filter(F.col(file).rlike(CHECK_LOG_NAME))
    return rows.withColumn("task_id", F.regexp_extract(file, CHECK_LOG_NAME, 1).cast("bigint")).withColumn(
        "shard", F.regexp_extract(file, CHECK_LOG_NAME, 2).cast("bigint")
    )


def parse_progress_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, shard) of ``[date] STATUS: ...`` lines.

    The shard is the number after the word shard, or else the last number in the name of the
    archive that the line gives the path of, or else the first number.
    """
    pattern = r"^\[[^\]]*\] (SUCCESS|FAILED|SKIPPED): (.*\d.*)$"
    rows = lines.filter(F.col(line).rlike(pattern))
    rest = F.regexp_extract(line, pattern, 2)
    places = [r"(?i)\bshard (\d+)", r"(\d+)[^/\d]*\.tar\b", r"(\d+)"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(rest, place, 1), F.lit("")) for place in places])
    return rows.select(F.regexp_extract(line, pattern, 1).alias("status"), found.cast("bigint").alias("shard"))


# The phrases of a check log.
CHECK_INDEX = r"文件索引: (\d+)"
CHECK_OK = ("✅ 文件", "正常")
CHECK_SAMPLES = r"共 (\d+) 个样本"
CHECK_BAD = "❌ 文件"
CHECK_ERROR = r"错误 - (.+)"


def parse_check_logs(files: DataFrame, content: str = "content") -> DataFrame:
    """Add (shard, status, samples, error) from the text of check logs.

    ``status`` is ok, error or unknown; samples are 0 unless ok, the error is null unless
    error. Files that name no shard are dropped.
    """
    shard = F.regexp_extract(content, CHECK_INDEX, 1)
    good = F.contains(F.col(content), F.lit(CHECK_OK[0])) & F.contains(F.col(content), F.lit(CHECK_OK[1]))
    bad = ~good & F.contains(F.col(content), F.lit(CHECK_BAD))
    samples = F.nullif(F.regexp_extract(content, CHECK_SAMPLES, 1), F.lit("")).cast("bigint")
    return files.filter(shard != "").select(
        *[c for c in files.columns if c != content],
        shard.cast("bigint").alias("shard"),
        F.when(good, "ok").when(bad, "error").otherwise("unknown").alias("status"),
        F.when(good, F.coalesce(samples, F.lit(0))).otherwise(0).cast("bigint").alias("samples"),
        F.when(bad, F.trim(F.regexp_extract(content, CHECK_ERROR, 1))).alias("error"),
    )
