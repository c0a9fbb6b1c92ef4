"""Queries over sharded sample datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import core, text
from tesserae.operators import dataset
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, u
from tesserae.plans.views import Tables


def _encoded(t: Tables):
    """Documents stored under different image extensions, by language."""
    d = t.table("documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(
        t_key("doc_id"),
        F.when(F.col("lang") == "en", name).alias("jpg"),
        F.when(F.col("source") == "src3", F.concat(name, F.lit("p"))).alias("png"),
        F.when(F.col("lang") == "fr", F.concat(name, F.lit("e"))).alias("jpeg"),
        F.when(F.col("lang") == "es", F.concat(name, F.lit("w"))).alias("webp"),
        F.col("n_chars").alias("cls"),
        F.col("lang").alias("other"),
    )


def t_key(column: str):
    return F.lpad(F.col(column).cast("string"), 8, "0").alias("key")


_ENCODED = """WITH enc AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS key, n_chars AS cls,
    CASE WHEN lang = 'en' THEN source || '/' || doc_id::VARCHAR
         WHEN source = 'src3' THEN source || '/' || doc_id::VARCHAR || 'p'
         WHEN lang = 'fr' THEN source || '/' || doc_id::VARCHAR || 'e'
         WHEN lang = 'es' THEN source || '/' || doc_id::VARCHAR || 'w' END AS image FROM documents)
"""


@query("p1_first_present", _ENCODED + "SELECT key, image, image IS NULL AS rejected FROM enc")
def _(t: Tables):
    good, bad = dataset.first_present(_encoded(t), dataset.IMAGE_EXTENSIONS, "image")
    cols = ["key", "image"]
    return good.select(*cols, F.lit(False).alias("rejected")).unionByName(
        bad.select(*cols, F.lit(True).alias("rejected"))
    )


@query("p2_column_subset", _ENCODED + "SELECT key, image, cls FROM enc WHERE image IS NOT NULL")
def _(t: Tables):
    good, _bad = dataset.first_present(_encoded(t), dataset.IMAGE_EXTENSIONS, "image")
    return dataset.keep_columns(good, ["key", "image", "cls", "absent"])


_CLS = "split_part(url, '/', len(string_split(url, '/')))"


@query(
    "p3_typed_conversion",
    f"""WITH c AS (SELECT page_id AS key, {_CLS} AS raw FROM pages)
        SELECT key, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN raw::INT END AS cls,
          CASE WHEN NOT regexp_full_match(raw, '[0-9]+') THEN raw END AS raw FROM c""",
)
def _(t: Tables):
    pages = t.table("pages").select(F.col("page_id").alias("key"), text.base_name("url").alias("cls"))
    good, bad = dataset.convert(pages, "cls", "int")
    return good.select("key", "cls", F.lit(None).cast("string").alias("raw")).unionByName(
        bad.select("key", F.lit(None).cast("int").alias("cls"), F.col("cls").alias("raw"))
    )


@query(
    "p4_unknown_labels",
    """SELECT key, label_str FROM raw_labels
       WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = label_str)""",
    "raw_labels",
)
def _(t: Tables):
    looked = dataset.look_up(t.raw_labels, t.dictionary, "label_str", "name", "idx")
    return dataset.known_only(looked, "idx")[1].select("key", "label_str")


@query(
    "j1_dictionary_lookup",
    """SELECT key, label_str, n_nationkey::BIGINT AS idx FROM raw_labels JOIN nation ON n_name = label_str""",
    "raw_labels",
)
def _(t: Tables):
    looked = dataset.look_up(t.raw_labels, t.dictionary, "label_str", "name", "idx")
    return dataset.known_only(looked, "idx")[0].select("key", "label_str", "idx")


@query(
    "j2_move_plan",
    """SELECT lpad(key::VARCHAR, 8, '0') || '.JPEG' AS src,
         lpad(n_nationkey::VARCHAR, 4, '0') || '/' || lpad(key::VARCHAR, 8, '0') || '.JPEG' AS dst
       FROM raw_labels JOIN nation ON n_name = label_str""",
    "raw_labels",
)
def _(t: Tables):
    listing = t.raw_labels.select(
        F.concat(F.lpad(F.col("key").cast("string"), 8, "0"), F.lit(".JPEG")).alias("file"),
        F.col("label_str").alias("label"),
    )
    classes = t.dictionary.select("name", F.lpad(F.col("idx").cast("string"), 4, "0").alias("folder"))
    return dataset.move_plan(listing, classes)


@query(
    "j3_pair_by_key",
    """SELECT coalesce(e.vec_id, l.doc_id) AS image_id,
         CASE WHEN l.doc_id IS NULL THEN 'no_fake' WHEN e.vec_id IS NULL THEN 'no_real'
              WHEN len(e.embedding) <> CASE WHEN l.toxic = 1 THEN 2 ELSE 64 END THEN 'shape'
              ELSE 'paired' END AS state
       FROM embeddings e FULL OUTER JOIN labels l ON e.vec_id = l.doc_id""",
)
def _(t: Tables):
    real = t.vectors.select("image_id", F.col("v").alias("real"))
    width = F.when(F.col("toxic") == 1, 2).otherwise(64)
    fake = t.table("labels").select(
        F.col("doc_id").alias("image_id"), F.array_repeat(F.col("quality"), width).alias("fake")
    )
    return dataset.pair_by_key(real, fake, "image_id").select("image_id", "state")


@query(
    "j4_pair_by_position",
    f"""WITH a AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS position
               FROM (SELECT vec_id AS image_id FROM embeddings)),
        b AS (SELECT vec_id AS other_id, row_number() OVER (ORDER BY {u("'other'", "vec_id")}, vec_id) AS position
               FROM embeddings)
        SELECT position, image_id, other_id FROM a JOIN b USING (position)""",
)
def _(t: Tables):
    left = t.table("embeddings").select(F.col("vec_id").alias("image_id"))
    right = t.table("embeddings").select(
        F.col("vec_id").alias("other_id"), core.uniform(F.lit("other"), "vec_id").alias("draw")
    )
    out = dataset.pair_by_position(left, right, ["image_id"], ["draw", "other_id"])
    return out.select("position", "image_id", "other_id")


_VIEW_SQL = ", ".join(
    f"({int(256 * crop)}, {offset}, {v}, {x}, {y}, {str(m).lower()})"
    for crop, offset in dataset.VIEW_SETS
    for v, x, y, m in dataset.view_plan(256, crop)
)


@query(
    "p6_view_expansion",
    """WITH sets AS (SELECT * FROM (VALUES (281, 0, 25, 12), (268, 71, 12, 6)) s(resized, off, far, mid)),
         spots AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1), (4, -1, -1)) p(spot, fx, fy))
       SELECT shard + off AS shard, key || '_' || (spot + 5 * m)::VARCHAR AS key, n_chars, doc_id,
         resized::BIGINT AS resized, (CASE WHEN fx < 0 THEN mid ELSE fx * far END)::BIGINT AS x0,
         (CASE WHEN fy < 0 THEN mid ELSE fy * far END)::BIGINT AS y0, m = 1 AS mirrored
       FROM docs, sets, spots, (VALUES (0), (1)) mm(m)""",
    "docs",
)
def _(t: Tables):
    return dataset.expand_views(t.documents_by_shard)


@query(
    "p8_clamp_quantise",
    f"""SELECT image_id, p, {r("least(greatest(v * 4, 0), 1)")} AS clamped,
          floor(least(greatest(v * 4, 0), 1) * 255 + 0.5)::BIGINT AS nearest,
          floor((v + 1) / 2 * 255)::INT AS truncated FROM vec""",
    "vec",
)
def _(t: Tables):
    rows = t.vectors.select("image_id", F.posexplode("v").alias("p", "v"))
    return rows.select(
        "image_id",
        F.col("p").cast("bigint").alias("p"),
        core.rounded(core.clamp(F.col("v") * 4)).alias("clamped"),
        F.floor(core.quantise_round(F.col("v") * 4) * 255 + 0.5).alias("nearest"),
        core.quantise_floor((F.col("v") + 1) / 2).alias("truncated"),
    )


@query(
    "p9_gray",
    f"""SELECT a.image_id, a.p, {r("0.2989::DOUBLE * a.v + 0.5870::DOUBLE * b.v + 0.1140::DOUBLE * c.v")} AS gray
        FROM vec a JOIN vec b ON b.image_id = a.image_id AND b.p = (a.p + 1) % 64
        JOIN vec c ON c.image_id = a.image_id AND c.p = (a.p + 2) % 64""",
    "vec",
)
def _(t: Tables):
    def at(step):
        return F.element_at("v", F.pmod(F.col("p") + step, F.size("v")) + 1)

    rows = t.vectors.select("image_id", "v", F.posexplode("v").alias("p", "_"))
    return rows.select(
        "image_id", F.col("p").cast("bigint").alias("p"), core.rounded(core.luma(at(0), at(1), at(2))).alias("gray")
    )


@query(
    "w2_running_number",
    """SELECT key, row_number() OVER (ORDER BY key) - 1 AS number,
         lpad((row_number() OVER (ORDER BY key) - 1)::VARCHAR, 8, '0') AS sample FROM docs""",
    "docs",
)
def _(t: Tables):
    docs = t.documents_by_shard.select("key")
    return dataset.number_samples(docs, ["key"])


@query(
    "s2_shard_assignment",
    f"""SELECT key, number, number // 37 AS shard, lpad(number::VARCHAR, 8, '0') AS sample
        FROM (SELECT key, row_number() OVER (ORDER BY {u("'order'", "key")}, key) - 1 AS number FROM docs)""",
    "docs",
)
def _(t: Tables):
    docs = t.documents_by_shard.select("key", core.uniform(F.lit("order"), "key").alias("draw"))
    out = dataset.assign_shards(dataset.number_samples(docs, ["draw", "key"]), 37)
    return out.select("key", "number", "shard", "sample")


@query(
    "w3_batches",
    """SELECT shard, key, (n - 1) // 8 AS batch, ((n - 1) // 8 + 1) * 8 <= total AS whole
       FROM (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key) AS n,
               count(*) OVER (PARTITION BY shard) AS total FROM docs)""",
    "docs",
)
def _(t: Tables):
    docs = t.documents_by_shard.select("shard", "key")
    every = dataset.batches(docs, ["key"], 8)
    whole = dataset.batches(docs, ["key"], 8, keep_partial=False)
    flag = whole.select("shard", "key", F.lit(True).alias("whole"))
    return every.join(flag, ["shard", "key"], "left").withColumn(
        "whole", F.coalesce("whole", F.lit(False))
    )


@query(
    "w10_random_order",
    f"SELECT shard, key, row_number() OVER (ORDER BY {u("'shuffle'", 'key')}, key) AS place FROM docs",
    "docs",
)
def _(t: Tables):
    return dataset.shuffled(t.documents_by_shard.select("shard", "key"), "shuffle")


@query(
    "w11_rank_split",
    "SELECT key, ntile(7) OVER (ORDER BY key) - 1 AS rank FROM docs",
    "docs",
)
def _(t: Tables):
    numbered = dataset.number_samples(t.documents_by_shard.select("key"), ["key"])
    return dataset.split_among_ranks(numbered, 7).select("key", "rank")


@query(
    "w12_shard_split",
    "SELECT DISTINCT shard, shard % 4 AS node, (shard // 4) % 3 AS worker FROM docs",
    "docs",
)
def _(t: Tables):
    return dataset.split_shards(t.documents_by_shard.select("shard").distinct(), 4, 3)


@query(
    "d1_resampled_epoch",
    f"""WITH sizes AS (SELECT shard, count(*) AS size, row_number() OVER (ORDER BY shard) AS choice FROM docs GROUP BY shard),
        facts AS (SELECT count(*) AS shards, ceil(sum(size) / 128.0) * 128 AS wanted, min(size) AS smallest FROM sizes),
        draws AS (SELECT draw, floor({u("'epoch'", "draw")} * shards)::BIGINT + 1 AS choice, wanted
          FROM facts, LATERAL (SELECT unnest(range(ceil(wanted / smallest)::BIGINT)) AS draw)),
        run AS (SELECT draw, shard, size, wanted, sum(size) OVER (ORDER BY draw) - size AS start
          FROM draws JOIN sizes USING (choice)),
        inside AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS n FROM docs)
        SELECT draw, shard, key, (start + n)::BIGINT AS place, ((start + n) // 64)::BIGINT AS batch
        FROM run JOIN inside USING (shard) WHERE start < wanted AND start + n < wanted""",
    "docs",
)
def _(t: Tables):
    docs = t.documents_by_shard.select("shard", "key")
    out = dataset.resampled_epoch(docs, ["key"], global_batch=64, workers=2)
    return out.select("draw", "shard", "key", "place", "batch")


@query(
    "s3_folder_labels",
    f"""SELECT 'val/' || {_CLS} || '/' || page_id::VARCHAR || '.jpg' AS path,
          page_id::VARCHAR AS key, {_CLS}::INT AS cls FROM pages WHERE regexp_full_match({_CLS}, '[0-9]+')""",
)
def _(t: Tables):
    from tesserae.sources.files import folder_labels

    path = F.concat(
        F.lit("val/"), text.base_name("url"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".jpg")
    )
    return folder_labels(t.table("pages").select(path.alias("path")))


_S4 = """split_part(url, '/', 4) || '_' || page_id::VARCHAR || '_n' || lpad((page_id * 7919)::VARCHAR, 8, '0')
   || CASE WHEN url LIKE 'https:%' THEN '.JPEG' WHEN url LIKE '%#top' THEN '.png' ELSE '.jpg' END"""


@query(
    "s4_labels_from_names",
    f"""WITH m AS (SELECT {_S4} AS name FROM pages)
        SELECT name, substr(split_part(name, '_', 3), 1, 9) AS label FROM m
        WHERE lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg'""",
)
def _(t: Tables):
    from tesserae.sources.files import named_labels

    ext = (
        F.when(F.col("url").startswith("https:"), ".JPEG")
        .when(F.col("url").endswith("#top"), ".png")
        .otherwise(".jpg")
    )
    name = F.concat(
        F.element_at(F.split("url", "/"), 4),
        F.lit("_"),
        F.col("page_id").cast("string"),
        F.lit("_n"),
        F.lpad((F.col("page_id") * 7919).cast("string"), 8, "0"),
        ext,
    )
    return named_labels(t.table("pages").select(name.alias("name")))


@query(
    "s9_evaluation_batch",
    """SELECT sample, doc_id FROM (SELECT lpad(doc_id::VARCHAR, 6, '0') || '.png' AS sample, doc_id FROM documents)
       ORDER BY sample LIMIT 50""",
)
def _(t: Tables):
    names = t.table("documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".png")).alias("sample"), "doc_id"
    )
    return dataset.evaluation_batch(names, "sample", 50)


@query(
    "f7_names",
    f"""SELECT page_id, lpad(page_id::VARCHAR, 10, '0') AS id10, {_CLS} AS base,
          regexp_replace({_CLS}, '\\.[^.]*$', '') AS stem,
          split_part(url, '/', len(string_split(url, '/')) - 1) AS folder,
          regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages""",
)
def _(t: Tables):
    return t.table("pages").select(
        "page_id",
        text.zero_padded("page_id", 10).alias("id10"),
        text.base_name("url").alias("base"),
        text.stem("url").alias("stem"),
        text.parent_name("url").alias("folder"),
        F.regexp_extract("url", "/([0-9]+)", 1).alias("number"),
    )
