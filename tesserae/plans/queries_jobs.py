"""Queries that run whole jobs: archives, relabelling, resumable work, code extraction."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tesserae.functions.core import rounded
from tesserae.functions.text import base_name
from tesserae.functions.vectors import joined
from tesserae.operators import sequences
from tesserae.plans import jobs
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, u, view
from tesserae.plans.views import Tables
from tesserae.session import scratch
from tesserae.sources import archive, nested, tokens as token_io


def _scratch(t: Tables, name: str) -> str:
    return scratch(t.spark, name)


@query(
    "s1_archive_round_trip",
    """SELECT doc_id // 20 AS shard, lpad(doc_id::VARCHAR, 8, '0') AS key, 'txt' AS ext, strlen(text)::INT AS size, md5(text) AS digest FROM documents
       UNION ALL SELECT doc_id // 20, lpad(doc_id::VARCHAR, 8, '0'), 'cls', strlen(lang)::INT, md5(lang) FROM documents""",
)
def _(t: Tables):
    docs = t.table("documents").select(
        F.floor(F.col("doc_id") / 20).alias("shard"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"),
        archive.text_payload("text").alias("text"),
        archive.text_payload("lang").alias("lang"),
    )
    path = _scratch(t, "archive")
    archive.write_members(archive.wide_to_members(docs, {"txt": "text", "cls": "lang"}), path)
    back = archive.read_samples(t.spark, path)
    return back.select(
        "shard", "key", "ext", F.octet_length("payload").alias("size"), F.md5("payload").alias("digest")
    )


@query(
    "s1_sample_rows",
    """SELECT doc_id // 20 AS shard, lpad(doc_id::VARCHAR, 8, '0') AS key, md5(text) AS digest, lang AS label
       FROM documents WHERE doc_id // 20 >= 3 AND doc_id // 20 < 30""",
)
def _(t: Tables):
    """One row per sample of a range of shards; others are not opened."""
    docs = t.table("documents").select(
        F.floor(F.col("doc_id") / 20).alias("shard"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"),
        archive.text_payload("text").alias("text"),
        archive.text_payload("lang").alias("lang"),
    )
    columns = {"txt": "text", "cls": "lang"}
    path = _scratch(t, "sample-rows")
    archive.write_sample_rows(docs.select("shard", "key", archive.members_of(columns).alias("members")), path)
    rows = archive.read_sample_rows(t.spark, path, shards=range(3, 30))
    wide = archive.sample_columns(rows, columns)
    return wide.select("shard", "key", F.md5("text").alias("digest"), archive.payload_text("lang").alias("label"))


# Pages as image files by name: 16 to an inner archive, every other one of them packed, 8 of those to an outer archive.
_NAMED = """SELECT *, page_id // 16 AS batch, name || '.' || ext AS file FROM (SELECT page_id, html, 'p' || page_id::VARCHAR || '_n'
    || lpad((page_id * 7919)::VARCHAR, 8, '0') AS name, CASE WHEN url LIKE 'https:%' THEN 'JPEG' WHEN url LIKE '%#top' THEN 'png'
    ELSE 'jpg' END AS ext FROM pages WHERE html IS NOT NULL)"""
_OUTER = "'outer-' || lpad((batch // 8)::VARCHAR, 6, '0') || '.tar'"
_INNER = "'batch-' || lpad(batch::VARCHAR, 6, '0') || CASE WHEN batch % 2 = 0 THEN '.tar' ELSE '.tar.gz' END"


@F.pandas_udf(BinaryType())
def _squeezed(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda b: gzip.compress(b, mtime=0))


def _nested_folder(t: Tables) -> str:
    inner, outer = _scratch(t, "inner"), _scratch(t, "outer")
    pages = t.table("pages").filter(F.col("html").isNotNull())
    number = F.lpad((F.col("page_id") * 7919).cast("string"), 8, "0")
    ext = F.when(F.col("url").startswith("https:"), "JPEG").when(F.col("url").endswith("#top"), "png").otherwise("jpg")
    files = pages.select(
        F.floor(F.col("page_id") / 16).alias("shard"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_n"), number).alias("key"),
        ext.alias("ext"),
        archive.text_payload("html").alias("payload"),
    )
    archive.write_members(files, inner, "batch")
    whole = t.spark.read.format("binaryFile").load(inner).select(
        F.regexp_extract("path", r"(batch-\d+)\.tar$", 1).alias("key"), "content"
    )
    batch = F.substring_index("key", "-", -1).cast("bigint")
    even = batch % 2 == 0
    members = whole.select(
        F.floor(batch / 8).alias("shard"),
        "key",
        F.when(even, "tar").otherwise("tar.gz").alias("ext"),
        F.when(even, F.col("content")).otherwise(_squeezed("content")).alias("payload"),
    )
    archive.write_members(members, outer, "outer")
    return outer


@query(
    "s4_nested_images",
    f"""SELECT {_OUTER} AS archive, {_INNER} AS inner, file AS name, substr(split_part(name, '_', 2) || '.' || ext, 1, 9) AS label,
          strlen(html)::INT AS size, md5(html) AS digest FROM ({_NAMED}) WHERE lower(ext) IN ('jpg', 'jpeg')""",
)
def _(t: Tables):
    """Images of archives inside archives, with the label of their name; every range has a few members only."""
    images = nested.labelled_images(t.spark, _nested_folder(t), split_bytes=1 << 16)
    return images.select(
        base_name("archive").alias("archive"), "inner", "name", "label",
        F.octet_length("payload").alias("size"), F.md5("payload").alias("digest"),
    )


@query(
    "s4_converted_images",
    f"""SELECT number // 100 AS shard, lpad(number::VARCHAR, 8, '0') AS key, label AS cls, digest FROM (
          SELECT row_number() OVER (ORDER BY batch, name, ext) - 1 AS number,
            substr(split_part(name, '_', 2) || '.' || ext, 1, 9) AS label, md5(html) AS digest
          FROM ({_NAMED}) WHERE lower(ext) IN ('jpg', 'jpeg'))""",
)
def _(t: Tables):
    """The same images as sample shards, numbered in the order of the archives."""
    out = _scratch(t, "converted")
    jobs.convert_images(t.spark, _nested_folder(t), out, "val", 100)
    columns = {"jpg": "jpg", "cls": "cls"}
    rows = archive.sample_columns(archive.read_sample_rows(t.spark, out), columns)
    return rows.select("shard", "key", archive.payload_text("cls").alias("cls"), F.md5("jpg").alias("digest"))


_TOKEN_SAMPLES = """SELECT lpad(sample_key::VARCHAR, 8, '0') AS key, string_agg(code::VARCHAR, ',' ORDER BY pos) AS codes,
    string_agg(lod::VARCHAR, ',' ORDER BY pos) AS lods, string_agg(patch::VARCHAR, ',' ORDER BY pos) AS patches,
    any_value(o_custkey % 10) AS class_id, sample_key // 500 AS shard
  FROM tokens JOIN orders ON o_orderkey = sample_key GROUP BY sample_key"""


def _samples(t: Tables):
    rows = token_io.to_samples(t.tokens).join(t.sample_classes, "sample_key")
    return rows.select(
        F.lpad(F.col("sample_key").cast("string"), 8, "0").alias("key"),
        "codes",
        "lods",
        "patches",
        "class_id",
        F.floor(F.col("sample_key") / 500).alias("shard"),
    )


def _texts(samples):
    return samples.select("key", *[joined(c).alias(c) for c in ("codes", "lods", "patches")], "class_id", "shard")


@query("s5_token_table", _TOKEN_SAMPLES, "tokens")
def _(t: Tables):
    path = _scratch(t, "tokens")
    token_io.write_tokens(_samples(t), path)
    return _texts(token_io.read_tokens(t.spark, path))


@query("s5_token_archives", _TOKEN_SAMPLES, "tokens")
def _(t: Tables):
    path = _scratch(t, "token-archives")
    token_io.write_token_archives(_samples(t), path, compressed=True)
    return _texts(token_io.read_token_archives(t.spark, path))


@query(
    "d3_relabelled_archives",
    """SELECT key // 20 AS shard, lpad(key::VARCHAR, 8, '0') AS key, n_nationkey::VARCHAR AS cls, s_name AS jpg
       FROM raw_labels JOIN nation ON n_name = label_str JOIN supplier ON s_suppkey = key""",
    "raw_labels",
)
def _(t: Tables):
    named = t.table("supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    rows = t.raw_labels.join(named, "key").select(
        F.floor(F.col("key") / 20).alias("shard"),
        F.lpad(F.col("key").cast("string"), 8, "0").alias("key"),
        archive.text_payload("s_name").alias("jpg"),
        archive.text_payload("label_str").alias("cls"),
    )
    columns = {"jpg": "jpg", "cls": "cls"}
    before, after = _scratch(t, "before"), _scratch(t, "after")
    archive.write_members(archive.wide_to_members(rows, columns), before)
    jobs.relabel(t.spark, before, after, t.dictionary)
    back = archive.sample_columns(archive.read_sample_rows(t.spark, after), columns)
    return back.select(
        "shard", "key", archive.payload_text("cls").alias("cls"), archive.payload_text("jpg").alias("jpg")
    )


@query(
    "d5_resumed_job",
    """WITH have AS (SELECT DISTINCT doc_id // 20 AS shard FROM documents),
         bad AS (SELECT DISTINCT doc_id // 20 AS shard FROM documents WHERE n_chars < 10),
         first AS (SELECT DISTINCT vec_id // 20 AS shard FROM embeddings),
         second AS (SELECT DISTINCT page_id // 4 AS shard FROM pages),
         one AS (SELECT 'first' AS run, f.shard, CASE WHEN h.shard IS NULL THEN 'SKIPPED' WHEN b.shard IS NOT NULL THEN 'FAILED'
             ELSE 'SUCCESS' END AS status FROM first f LEFT JOIN have h USING (shard) LEFT JOIN bad b USING (shard))
       SELECT * FROM one UNION ALL
       SELECT 'second', s.shard, CASE WHEN h.shard IS NULL OR o.status = 'SUCCESS' THEN 'SKIPPED' WHEN b.shard IS NOT NULL
           THEN 'FAILED' ELSE 'SUCCESS' END
       FROM second s LEFT JOIN have h USING (shard) LEFT JOIN bad b USING (shard) LEFT JOIN one o ON o.shard = s.shard""",
)
def _(t: Tables):
    output, log = _scratch(t, "job"), _scratch(t, "job-log")
    docs = t.documents_by_shard
    first = t.table("embeddings").select(F.floor(F.col("vec_id") / 20).alias("shard"))
    second = t.table("pages").select(F.floor(F.col("page_id") / 4).alias("shard"))

    def step(rows):
        short = F.when(F.col("n_chars") < 10, F.lit("too short"))
        return rows.select("shard", "key", "n_chars", short.alias("error"))

    one = jobs.run_resumable(first, docs, step, output, log, "first")
    two = jobs.run_resumable(second, docs, step, output, log, "second")
    return one.unionByName(two).select("run", "shard", "status")


_SIDES = (1, 2, 4)
view(
    "view_nodes",
    f"""WITH v AS (SELECT vec_id // 50 AS shard, lpad(vec_id::VARCHAR, 8, '0') || '_' || i::VARCHAR AS key, vec_id
          FROM embeddings, (SELECT unnest(range(10)) AS i)),
        n1 AS (SELECT v.*, unnest(range(4)) AS patch FROM v)
        SELECT shard, key, vec_id, 0 AS lod, 0 AS patch, 0 AS idx FROM v
        UNION ALL SELECT shard, key, vec_id, 1, patch, 1 + patch FROM n1
        UNION ALL SELECT shard, key, vec_id, 2, (patch // 2) * 8 + (patch % 2) * 2 + c.o, 5 + 4 * patch + c.i
          FROM n1, (VALUES (0, 0), (1, 1), (2, 4), (3, 5)) c(i, o) WHERE {u("key", "1", "patch")} < 0.5""",
)
view(
    "view_tokens",
    """WITH z AS (SELECT n.key, n.idx, v.p, v.v FROM view_nodes n JOIN vec v ON v.image_id = n.vec_id),
       d AS (SELECT z.key, z.idx, c.code, sum((z.v - c.e) ** 2) AS d FROM z JOIN codebook c ON c.p = (z.p + z.idx) % 64
             GROUP BY z.key, z.idx, c.code)
       SELECT n.shard, n.key, row_number() OVER (PARTITION BY n.key ORDER BY n.idx) - 1 AS pos, b.code,
         n.lod::BIGINT AS lod, n.patch::BIGINT AS patch
       FROM view_nodes n JOIN (SELECT key, idx, min_by(code, d) AS code FROM d GROUP BY key, idx) b USING (key, idx)""",
    "view_nodes",
    "vec",
    "codebook",
)


def _rolled(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a user's model: the latent of a node is the vector rotated by its index."""
    z = [np.roll(v, int(i)) for v, i in zip(batch["v"], batch["idx"])]
    return batch[["shard", "key", "pos", "lod", "patch"]].assign(z=z)


def _extracted(t: Tables):
    rows = t.vectors.select(
        F.floor(F.col("image_id") / 50).alias("shard"),
        F.lpad(F.col("image_id").cast("string"), 8, "0").alias("key"),
        "v",
    )
    return jobs.extract_codes(rows, t.codebook, _rolled, 256, 1, [0.5], _SIDES)


@query("d6_extracted_codes", "SELECT * FROM view_tokens", "view_tokens")
def _(t: Tables):
    return _extracted(t)


@query(
    "d6_average_tokens",
    f"SELECT count(*) AS tokens, count(DISTINCT key) AS samples, {r('count(*) / count(DISTINCT key)')} AS avg_tokens FROM view_nodes",
    "view_nodes",
)
def _(t: Tables):
    sizes = sequences.lengths(_extracted(t), "key")
    out = sizes.agg(F.sum("len").alias("tokens"), F.count(F.lit(1)).alias("samples"))
    return out.withColumn("avg_tokens", rounded(F.col("tokens") / F.col("samples")))


@query(
    "u2_field_functions",
    """SELECT o_orderkey AS sample_key, (o_custkey % 10)::VARCHAR AS class_id FROM orders""",
)
def _(t: Tables):
    return jobs.map_fields(t.sample_classes, {"class_id": lambda c: c.cast("string"), "absent": F.upper})
