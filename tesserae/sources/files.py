"""Folder, nested-archive, JSON and log readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text


def folder_labels(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, key, cls) of files laid out as ``label/name``: the label is the folder as an
    integer, the key is the stem. Paths whose folder is no integer are skipped."""
    cls = text.parent_name(path).try_cast("int")
    rows = paths.select(F.col(path).alias("path"), text.stem(path).alias("key"), cls.alias("cls"))
    return rows.filter(F.col("cls").isNotNull())


def read_folder(spark: SparkSession, root: str, pattern: str = "*.{jpg,JPEG}") -> DataFrame:
    """(path, key, cls, content) of a class-per-folder image tree, one task per file group."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", pattern).load(root).select("path", "content")
    cls = text.parent_name("path").try_cast("int")
    return files.select("path", text.stem("path").alias("key"), cls.alias("cls"), "content").filter(F.col("cls").isNotNull())


def named_labels(members: DataFrame, name: str = "name") -> DataFrame:
    """(name, label) of JPEG members whose label is part of their name; others are skipped."""
    return members.filter(text.is_jpeg(name)).select(
        F.col(name).alias("name"), text.label_from_name(name).alias("label")
    )


def read_fixed_tree(spark: SparkSession, path: str) -> DataFrame:
    """(lod, patch) nodes of a saved tree, from its level-to-nodes map."""
    schema = (
        "status_data array<int>, "
        "final_tree map<string, array<struct<patch_index: bigint, lod_level: bigint>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    nodes = doc.select(F.explode("final_tree").alias("lod", "nodes")).select(F.explode("nodes").alias("n"))
    return nodes.select(F.col("n.lod_level").alias("lod"), F.col("n.patch_index").alias("patch"))


def read_fixed_status(spark: SparkSession, path: str) -> DataFrame:
    """(idx, status) of a saved tree."""
    doc = spark.read.schema("status_data array<int>").json(path, multiLine=True)
    return doc.select(F.posexplode("status_data").alias("idx", "status"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, category_id, x, y, w, h, score) from JSON lists of detections."""
    schema = "image_id bigint, category_id bigint, bbox array<double>, score double"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    sides = [F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")]
    return rows.select("image_id", "category_id", *sides, "score")


def read_match_map(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a class match map stored as one JSON object."""
    doc = spark.read.text(path, wholetext=True)
    pairs = doc.select(F.explode(F.from_json("value", "map<string, bigint>")).alias("k", "target"))
    return pairs.select(F.col("k").cast("bigint").alias("source"), "target")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, line) of text logs."""
    return spark.read.text(path).select(
        text.base_name(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("line"),
    )
