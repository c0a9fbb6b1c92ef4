"""Queries over token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.core import rounded, uniform
from tesserae.operators import codebook, sequences
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, u
from tesserae.plans.views import CODEBOOK_SIZE, Tables


@query(
    "a1_codebook_usage",
    "SELECT count(DISTINCT code) AS used, count(DISTINCT code) / 512.0::DOUBLE AS usage FROM tokens",
    "tokens",
)
def _(t: Tables):
    return codebook.usage(t.codes, CODEBOOK_SIZE)


@query(
    "a2_codebook_entropy",
    f"""WITH counts AS (SELECT k.code, count(t.code) AS n
          FROM (SELECT unnest(range(512)) AS code) k LEFT JOIN tokens t USING (code) GROUP BY k.code)
        SELECT {r("sum(-(n / total) * log2(n / total + 1e-8))")} AS entropy,
          min(n) AS min_freq, max(n) AS max_freq
        FROM (SELECT n, sum(n) OVER ()::DOUBLE AS total FROM counts)""",
    "tokens",
)
def _(t: Tables):
    return codebook.entropy(t.codes, CODEBOOK_SIZE).withColumn("entropy", rounded("entropy"))


@query(
    "a3_position_entropy",
    f"""WITH counts AS (SELECT pos, code, count(*) AS n FROM tokens GROUP BY pos, code)
        SELECT pos, sum(n)::BIGINT AS n, count(*) AS used,
          {r("sum(-(n / total) * log2(n / total + 1e-8))")} AS entropy
        FROM (SELECT pos, n, sum(n) OVER (PARTITION BY pos)::DOUBLE AS total FROM counts) GROUP BY pos""",
    "tokens",
)
def _(t: Tables):
    return codebook.position_entropy(t.tokens).withColumn("entropy", rounded("entropy"))


@query(
    "a25_tokens_per_sample",
    f"""SELECT count(DISTINCT sample_key) AS samples, count(*) AS tokens,
          {r("count(*) / count(DISTINCT sample_key)")} AS avg_tokens FROM tokens""",
    "tokens",
)
def _(t: Tables):
    return codebook.tokens_per_sample(t.codes).withColumn("avg_tokens", rounded("avg_tokens"))


@query(
    "a26_prefix_counts",
    """WITH h AS (SELECT sample_key, max(code) FILTER (pos = 0) AS c0, max(code) FILTER (pos = 1) AS c1
                  FROM tokens GROUP BY sample_key)
       SELECT 1 AS length, c0::VARCHAR AS prefix, count(*) AS n FROM h GROUP BY c0 HAVING count(*) >= 25
       UNION ALL SELECT 2, c0::VARCHAR || ',' || c1::VARCHAR, count(*) FROM h WHERE c1 IS NOT NULL
       GROUP BY c0, c1 HAVING count(*) >= 3""",
    "tokens",
)
def _(t: Tables):
    one = codebook.prefix_counts(t.tokens, 1, 25).select(F.lit(1).alias("length"), "prefix", "n")
    two = codebook.prefix_counts(t.tokens, 2, 3).select(F.lit(2).alias("length"), "prefix", "n")
    return one.unionByName(two).orderBy(F.desc("n"), "prefix")


@query(
    "a27_prefix_match",
    "SELECT sample_key FROM tokens WHERE pos = 0 AND code = 17",
    "tokens",
)
def _(t: Tables):
    return codebook.with_prefix(t.tokens, [17])


@query(
    "a28_token_accuracy",
    f"""WITH m AS (SELECT m.*, p.pred FROM masked m JOIN predicted p USING (sample_key, pos)),
        s AS (SELECT sample_key, avg((pred = code)::INT) AS acc FROM m WHERE rnk <= n_masked GROUP BY 1)
        SELECT 'masked' AS kind, {r("avg(acc)")} AS accuracy FROM s
        UNION ALL SELECT 'all', {r("avg((pred = code)::INT)")} FROM m""",
    "masked",
    "predicted",
)
def _(t: Tables):
    rows = sequences.mask_tokens(t.predicted_tokens, CODEBOOK_SIZE)
    masked = sequences.masked_accuracy(rows)
    everything = sequences.token_accuracy(t.predicted_tokens)
    return masked.select(
        F.lit("masked").alias("kind"), rounded("masked_accuracy").alias("accuracy")
    ).unionByName(
        everything.select(F.lit("all").alias("kind"), rounded("token_accuracy").alias("accuracy"))
    )


@query(
    "a29_weighted_loss",
    f"""WITH m AS (SELECT {u("'loss'", "sample_key", "pos")} AS loss,
               CASE WHEN rnk <= n_masked THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS w FROM masked)
        SELECT {r("sum(loss * w) / (sum(w) + 1e-8)")} AS weighted_loss FROM m""",
    "masked",
)
def _(t: Tables):
    rows = sequences.mask_tokens(t.tokens, CODEBOOK_SIZE)
    loss = uniform(F.lit("loss"), "sample_key", "pos")
    return sequences.weighted_loss(rows, loss, 0.1).withColumn(
        "weighted_loss", rounded("weighted_loss")
    )


_PADDED = """WITH s AS (SELECT sample_key, sample_key // 64 AS batch, count(*) AS len FROM tokens GROUP BY 1),
   w AS (SELECT *, max(len) OVER (PARTITION BY batch) AS width FROM s),
   padded AS (SELECT w.batch, w.sample_key, w.len, p.pos, coalesce(t.code, -1) AS code,
       coalesce(t.lod, -1) AS lod, coalesce(t.patch, -1) AS patch
     FROM w, LATERAL (SELECT unnest(range(w.width)) AS pos) p
     LEFT JOIN tokens t ON t.sample_key = w.sample_key AND t.pos = p.pos)
"""


def _padded(t: Tables):
    return sequences.pad(t.tokens, F.floor(F.col("sample_key") / 64))


@query("f1_pad_to_batch", _PADDED + "SELECT * FROM padded", "tokens")
def _(t: Tables):
    return _padded(t)


@query(
    "p11_next_token",
    _PADDED
    + """SELECT sample_key, pos, CASE WHEN before = -1 THEN 0 ELSE before END AS input,
           code AS target, code <> -1 AS valid
         FROM (SELECT *, lag(code) OVER (PARTITION BY sample_key ORDER BY pos) AS before FROM padded)""",
    "tokens",
)
def _(t: Tables):
    return sequences.next_token_pairs(_padded(t))


@query(
    "p7_truncate",
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY sample_key) AS len FROM tokens)
        SELECT 'fixed' AS cut, sample_key, pos, code FROM n WHERE pos < 3
        UNION ALL SELECT 'random', sample_key, pos, code FROM n
        WHERE pos < floor({u("'cut'", "sample_key")} * len) + 1""",
    "tokens",
)
def _(t: Tables):
    cols = ["sample_key", "pos", "code"]
    fixed = sequences.truncate(t.tokens, 3).select(F.lit("fixed").alias("cut"), *cols)
    rand = sequences.truncate_random(t.tokens).select(F.lit("random").alias("cut"), *cols)
    return fixed.unionByName(rand)


@query(
    "p10_label_dropout",
    f"""SELECT o_orderkey AS sample_key, CASE WHEN {u("'drop'", "o_orderkey")} < 0.1 THEN 10
          ELSE o_custkey % 10 END AS class_id FROM orders""",
)
def _(t: Tables):
    return sequences.drop_labels(t.sample_classes, 10, 0.1)


@query(
    "f5_random_mask",
    """SELECT sample_key, pos, rnk <= n_masked AS masked, n_masked,
         CASE WHEN rnk <= n_masked THEN 512 ELSE code END AS token FROM masked""",
    "masked",
)
def _(t: Tables):
    rows = sequences.mask_tokens(t.tokens, CODEBOOK_SIZE)
    return rows.select("sample_key", "pos", "masked", "n_masked", "token")


@query(
    "e1_union_of_codes",
    "SELECT l_partkey % 500 AS code FROM lineitem UNION SELECT p_partkey % 500 FROM part",
)
def _(t: Tables):
    parts = t.table("part").select((F.col("p_partkey") % 500).alias("code"))
    return codebook.union_of_codes(t.codes, parts)
