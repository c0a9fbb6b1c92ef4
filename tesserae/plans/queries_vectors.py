"""Queries over feature vectors, code books and class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import vectors as vec
from tesserae.functions.core import rounded
from tesserae.operators import neighbours as nb
from tesserae.operators import quality
from tesserae.plans.catalogue import query
from tesserae.plans.oracle_views import r, view
from tesserae.plans.views import Tables

view("rv", "SELECT image_id AS id, p, v FROM vec", "vec")
view("fv", "SELECT image_id AS id, p, floor(v * 10 + 0.5) / 10 AS v FROM vec", "vec")


def _pair_distances(name: str, a: str, b: str) -> None:
    view(
        name,
        f"""SELECT x.id, y.id AS other, sum((x.v - y.v) ** 2) AS d FROM {a} x JOIN {b} y ON x.p = y.p
            GROUP BY x.id, y.id""",
        a,
        b,
    )


_pair_distances("d_rr", "rv", "rv")
_pair_distances("d_fr", "fv", "rv")
_pair_distances("d_ff", "fv", "fv")
for _s in ("rr", "ff"):
    view(
        f"radius_{_s}",
        f"""SELECT id, d AS radius FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rn
            FROM d_{_s}) WHERE rn = 4""",
        f"d_{_s}",
    )


def _real(t: Tables):
    return t.vectors.select(F.col("image_id").alias("id"), "v")


def _fake(t: Tables):
    coarse = F.transform("v", lambda x: F.floor(x * 10 + 0.5) / 10)
    return t.vectors.select(F.col("image_id").alias("id"), coarse.alias("v"))


@query(
    "j7_nearest_code",
    f"""WITH d AS (SELECT v.image_id, c.code, sum((v.v - c.e) ** 2) AS d, sum(c.e * c.e) AS ee, sum(v.v * v.v) AS vv,
            sum(v.v * c.e) AS ve FROM vec v JOIN codebook c USING (p) GROUP BY v.image_id, c.code)
        SELECT image_id, min_by(code, d) AS code, {r("min(d)")} AS distance, min_by(code, -ve / sqrt(ee * vv)) AS unit_code,
          {r("min(2 - 2 * ve / sqrt(ee * vv))")} AS unit_distance FROM d GROUP BY image_id""",
    "vec",
    "codebook",
)
def _(t: Tables):
    plain = nb.nearest_code(t.vectors, t.codebook, "v").withColumnsRenamed({"code": "c1", "distance": "d1"})
    unit = nb.nearest_code(plain, t.codebook, "v", normalise=True)
    return unit.select(
        "image_id",
        F.col("c1").alias("code"),
        rounded("d1").alias("distance"),
        F.col("code").alias("unit_code"),
        rounded("distance").alias("unit_distance"),
    )


@query(
    "j8_codebook_lookup",
    "SELECT v.image_id, c.p, c.e FROM (SELECT vec_id AS image_id, label FROM embeddings) v JOIN codebook c ON c.code = v.label",
    "codebook",
)
def _(t: Tables):
    rows = t.vectors.select("image_id", F.col("label").alias("code"))
    found = nb.entry_of_code(rows, t.codebook)
    out = found.select("image_id", F.posexplode("e").alias("p", "e"))
    return out.withColumn("p", F.col("p").cast("bigint"))


@query(
    "j8_soft_lookup",
    f"""SELECT image_id, c.p, {r("sum(q.p * c.e)")} AS z FROM probs q
        JOIN (SELECT row_number() OVER (PARTITION BY p ORDER BY code) - 1 AS class, p, e FROM codebook) c USING (class)
        GROUP BY image_id, c.p""",
    "probs",
    "codebook",
)
def _(t: Tables):
    soft = nb.soft_entry(t.prob_rows, t.codebook, "probs")
    out = soft.select("image_id", F.posexplode("z").alias("p", "z"))
    return out.select("image_id", F.col("p").cast("bigint").alias("p"), rounded("z").alias("z"))


@query("j9_manifold_radii", f"SELECT id, {r('radius')} AS radius FROM radius_rr", "radius_rr")
def _(t: Tables):
    return nb.manifold_radii(_real(t)).withColumn("radius", rounded("radius"))


@query(
    "j9_clamped_radii",
    f"""SELECT id, {r("CASE WHEN radius > (SELECT quantile_cont(radius, 0.9) FROM radius_rr) THEN 0 ELSE radius END")} AS radius
        FROM radius_rr""",
    "radius_rr",
)
def _(t: Tables):
    return nb.manifold_radii(_real(t), clamp_percentile=90.0).withColumn("radius", rounded("radius"))


@query(
    "j10_manifold_membership",
    f"""SELECT d.id, max((d.d <= q.radius)::INT) = 1 AS inside, {r("max(q.radius / (d.d + 1e-5))", 4)} AS realism,
          min_by(d.other, d.d) AS nearest FROM d_fr d JOIN radius_rr q ON q.id = d.other GROUP BY d.id""",
    "d_fr",
    "radius_rr",
)
def _(t: Tables):
    out = nb.in_manifold(_fake(t), _real(t), nb.manifold_radii(_real(t)))
    return out.withColumn("realism", rounded("realism", 4))


@query(
    "j10_precision_recall",
    f"""SELECT (SELECT {r("avg(i)")} FROM (SELECT max((d.d <= q.radius)::INT) AS i FROM d_fr d JOIN radius_rr q ON q.id = d.other GROUP BY d.id)) AS precision,
          (SELECT {r("avg(i)")} FROM (SELECT max((d.d <= q.radius)::INT) AS i FROM d_fr d JOIN radius_ff q ON q.id = d.id GROUP BY d.other)) AS recall""",
    "d_fr",
    "radius_rr",
    "radius_ff",
)
def _(t: Tables):
    out = nb.precision_recall(_real(t), _fake(t))
    return out.select(rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@query(
    "a6_mean_covariance",
    f"""WITH m AS (SELECT p, avg(v) AS mean FROM vec GROUP BY p)
        SELECT a.p AS i, b.p AS j, {r("any_value(ma.mean)")} AS mean,
          {r("sum((a.v - ma.mean) * (b.v - mb.mean)) / (count(*) - 1)")} AS cov
        FROM vec a JOIN vec b USING (image_id) JOIN m ma ON ma.p = a.p JOIN m mb ON mb.p = b.p GROUP BY a.p, b.p""",
    "vec",
)
def _(t: Tables):
    out = quality.covariance(quality.moment_sums(t.vectors, "v"))
    return out.select("i", "j", rounded("mean").alias("mean"), rounded("cov").alias("cov"))


@query(
    "a7_affine_distance",
    # For fake = a * real + b the distance is |(a - 1) mean + b|^2 + (a - 1)^2 * (sum of variances).
    f"SELECT {r('sum((-0.5 * m + 0.25) ** 2 + 0.25 * s)', 5)} AS distance FROM (SELECT avg(v) AS m, var_samp(v) AS s FROM vec GROUP BY p)",
    "vec",
)
def _(t: Tables):
    fake = t.vectors.select(F.transform("v", lambda x: x * 0.5 + 0.25).alias("v"))
    value = quality.frechet_distance(t.vectors, fake)
    return t.spark.createDataFrame([(value,)], "distance double").withColumn("distance", rounded("distance", 5))


@query("a7_frechet_distance")
def _(t: Tables):
    value = quality.frechet_distance(_real(t), _fake(t))
    same = quality.frechet_distance(_real(t), _real(t))
    return t.spark.createDataFrame([(value, same)], "distance double, self_distance double")


@query(
    "a8_inception_score",
    f"""SELECT {r("exp(sum((k - s * ln(s / n + 1e-16)) / n))", 4)} AS score FROM (
          SELECT class, count(*) AS n, sum(p) AS s, sum(p * ln(p + 1e-16)) AS k FROM probs GROUP BY class)""",
    "probs",
)
def _(t: Tables):
    return quality.inception_score(t.probs).withColumn("score", rounded("score", 4))


@query(
    "a9_split_inception_score",
    f"""WITH b AS (SELECT *, (dense_rank() OVER (ORDER BY image_id) - 1) // 128 AS block FROM probs),
        m AS (SELECT *, avg(p) OVER (PARTITION BY block, class) AS mean FROM b),
        k AS (SELECT block, image_id, sum(p * (ln(p) - ln(mean))) AS kl FROM m GROUP BY block, image_id)
        SELECT {r("avg(s)", 4)} AS score FROM (SELECT exp(avg(kl)) AS s FROM k GROUP BY block)""",
    "probs",
)
def _(t: Tables):
    out = quality.split_inception_score(t.prob_rows, "image_id", "probs", 128)
    return out.withColumn("score", rounded("score", 4))


@query(
    "a10_top_accuracy",
    f"""SELECT {r("avg((rk = 1)::INT)")} AS top1, {r("avg((rk <= 5)::INT)")} AS top5 FROM (
          SELECT image_id, label, class, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, class) AS rk FROM probs)
        WHERE class = label""",
    "probs",
)
def _(t: Tables):
    out = quality.top_accuracy(t.prob_rows, "probs", "label")
    return out.select(rounded("top1").alias("top1"), rounded("top5").alias("top5"))


@query(
    "a11_vector_agreement",
    f"""WITH c AS (SELECT image_id, sum(re * fa) / (sqrt(sum(re * re)) * sqrt(sum(fa * fa))) AS c, avg(abs(re - fa)) AS a,
            avg((re - fa) ** 2) AS s FROM pair GROUP BY image_id)
        SELECT {r("avg(c)")} AS cosine_mean, {r("stddev_pop(c)")} AS cosine_std, {r("avg(a)")} AS l1, {r("avg(s)")} AS l2 FROM c""",
    "pair",
)
def _(t: Tables):
    out = quality.agreement(t.pairs)
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "w7_top_k_top_p",
    f"""WITH k AS (SELECT *, rank() OVER (PARTITION BY image_id ORDER BY p DESC) AS rk FROM probs),
        c AS (SELECT *, sum(p) OVER (PARTITION BY image_id) AS total, coalesce(sum(p) OVER (PARTITION BY image_id
            ORDER BY p DESC, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE rk <= 6)
        SELECT image_id, class, {r("p")} AS p FROM c WHERE before / total <= 0.6""",
    "probs",
)
def _(t: Tables):
    kept = quality.top_k_top_p(t.probs, 6, 0.6)
    return kept.select("image_id", "class", rounded("p").alias("p"))


@query(
    "f6_softmax",
    f"SELECT image_id, class, {r('p')} AS p, {r('ln(p)')} AS log_p FROM probs",
    "probs",
)
def _(t: Tables):
    return t.probs.select("image_id", "class", rounded("p").alias("p"), rounded(F.log("p")).alias("log_p"))


@query(
    "f6_mean_entropy",
    f"SELECT {r('sum(-p * ln(p + 1e-9)) / count(DISTINCT image_id)')} AS entropy FROM probs",
    "probs",
)
def _(t: Tables):
    return quality.mean_entropy(t.prob_rows, "probs").withColumn("entropy", rounded("entropy"))


@query(
    "f10_vector_functions",
    f"""SELECT image_id, {r("sum(re * fa)")} AS dot, {r("sum((re - fa) ** 2)")} AS squared, {r("sqrt(sum(re * re))")} AS norm,
          {r("sum(re) / sqrt(sum(re * re))")} AS unit_sum FROM pair GROUP BY image_id""",
    "pair",
)
def _(t: Tables):
    return t.pairs.select(
        "image_id",
        rounded(vec.dot("real", "fake")).alias("dot"),
        rounded(vec.squared_distance("real", "fake")).alias("squared"),
        rounded(vec.norm("real")).alias("norm"),
        rounded(vec.total(vec.normalise("real"))).alias("unit_sum"),
    )
