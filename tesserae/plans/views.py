"""Example inputs derived from the analytics tables, as Spark plans.

``Tables`` maps a folder of parquet tables onto the shapes the operators work on: token
sequences, pixels, real and reconstructed vectors, label maps, class probabilities,
archive members, run logs, boxes and quadtrees. Nothing here is sampled or cut down:
every view grows with its source tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.core import rounded, uniform
from tesserae.functions.vectors import softmax
from tesserae.operators import tree as tree_ops
from tesserae.operators.neighbours import codebook_products
from tesserae.operators.ordering import number_rows

#: Size of the code book the token codes are drawn from (some codes stay unused).
CODEBOOK_SIZE = 512
#: Probabilities of growing a node at the first and second free level.
GROWTH = (0.3, 0.2)
#: Levels every example tree has in full.
GUARANTEED_DEPTH = 3
#: Side of the small square images an embedding is read as.
IMAGE_SIDE = 8

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


class Tables:
    """Lazy access to source tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # token sequences -----------------------------------------------------------------
    @cached_property
    def tokens(self) -> DataFrame:
        """(sample_key, pos, code, lod, patch): one row per token."""
        lines = self.table("lineitem").select("l_orderkey", *_LINE_ORDER)
        rows = number_rows(lines, ["l_orderkey"], _LINE_ORDER, "rn")
        pos = F.col("rn") - 1
        lod = F.when(pos < 1, 0).when(pos < 5, 1).otherwise(2)
        first = F.when(pos < 1, 0).when(pos < 5, 1).otherwise(5)
        return rows.select(
            F.col("l_orderkey").alias("sample_key"),
            pos.alias("pos"),
            (F.col("l_partkey") % 500).alias("code"),
            lod.cast("bigint").alias("lod"),
            (pos - first).alias("patch"),
        )

    @cached_property
    def codes(self) -> DataFrame:
        """(sample_key, code) without positions: needs no ordering, so no shuffle."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("sample_key"), (F.col("l_partkey") % 500).alias("code")
        )

    @cached_property
    def sample_classes(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("sample_key"), (F.col("o_custkey") % 10).alias("class_id")
        )

    @cached_property
    def predicted_tokens(self) -> DataFrame:
        """Tokens with a prediction that differs from the target for about 30 % of rows."""
        wrong = uniform(F.lit("pred"), "sample_key", "pos") < 0.3
        code = F.col("code")
        return self.tokens.withColumn("pred", F.when(wrong, (code + 1) % 500).otherwise(code))

    # vectors and images --------------------------------------------------------------
    @cached_property
    def vectors(self) -> DataFrame:
        """(image_id, label, v): vectors as double arrays."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("image_id"),
            F.col("label").cast("bigint").alias("label"),
            F.transform("embedding", lambda e: e.cast("double")).alias("v"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """(image_id, y, x, v, gray): each vector read as an 8 by 8 image."""
        rows = self.vectors.select("image_id", F.posexplode("v").alias("p", "v"))
        gray = F.least(F.greatest(F.floor((F.col("v") + 1) * 127.5), F.lit(0)), F.lit(255))
        return rows.select(
            "image_id",
            F.floor(F.col("p") / IMAGE_SIDE).alias("y"),
            F.pmod("p", F.lit(IMAGE_SIDE)).cast("bigint").alias("x"),
            "v",
            gray.cast("bigint").alias("gray"),
        )

    @cached_property
    def images(self) -> DataFrame:
        """(image_id, height, width, gray[], gt[], pred[]): vectors as whole images of three shapes."""
        shape = F.pmod("image_id", F.lit(3))
        width = F.when(shape == 0, 8).when(shape == 1, 4).otherwise(16).cast("int")
        rows = self.vectors.withColumn("width", width)

        def level(v: Column) -> Column:
            return F.least(F.greatest(F.floor((v + 0.3) * 6), F.lit(0)), F.lit(3)).cast("bigint")

        def true_class(v: Column, p: Column) -> Column:
            place = F.col("image_id") + F.floor(p / F.col("width")) + p % F.col("width")
            return F.when(F.pmod(place, F.lit(50)) == 0, F.lit(1000).cast("bigint")).otherwise(level(v))

        gray = F.transform("v", lambda v: F.least(F.greatest(F.floor((v + 1) * 127.5), F.lit(0)), F.lit(255)))
        return rows.select(
            "image_id",
            F.floor(F.size("v") / F.col("width")).cast("int").alias("height"),
            "width",
            gray.alias("gray"),
            F.transform("v", true_class).alias("gt"),
            F.transform("v", lambda v: level(F.floor(v * 10 + 0.5) / 10)).alias("pred"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """(image_id, real[], fake[]): a vector and its coarse reconstruction, in [0, 1]."""
        return self.vectors.select(
            "image_id",
            F.transform("v", lambda v: (v + 1) / 2).alias("real"),
            F.transform("v", lambda v: (F.floor(v * 10 + 0.5) / 10 + 1) / 2).alias("fake"),
        )

    @cached_property
    def seg(self) -> DataFrame:
        """(image_id, y, x, gt, pred): label maps, 1000 marks ignored pixels."""

        def level(v: Column) -> Column:
            return F.least(F.greatest(F.floor((v + 0.3) * 6), F.lit(0)), F.lit(3)).cast("bigint")

        coarse = F.floor(F.col("v") * 10 + 0.5) / 10
        ignored = F.pmod(F.col("image_id") + F.col("y") + F.col("x"), F.lit(50)) == 0
        return self.pixels.select(
            "image_id",
            "y",
            "x",
            F.when(ignored, F.lit(1000).cast("bigint")).otherwise(level(F.col("v"))).alias("gt"),
            level(coarse).alias("pred"),
        )

    @cached_property
    def codebook(self) -> DataFrame:
        """(code, e[]): one entry per label, the mean vector of that label."""
        means = (
            self.vectors.select("label", F.posexplode("v").alias("p", "v"))
            .groupBy("label", "p")
            .agg(rounded(F.avg("v")).alias("e"))
        )
        # One array per label with one element per dimension: bounded by the vector size.
        entries = F.array_sort(F.collect_list(F.struct("p", "e")))
        return means.groupBy(F.col("label").alias("code")).agg(
            F.transform(entries, lambda s: s["e"]).alias("e")
        )

    @cached_property
    def prob_rows(self) -> DataFrame:
        """(image_id, label, probs[]): softmax over the scaled code book products."""
        scored = codebook_products(self.vectors, self.codebook, "v", "logits", scale=10.0)
        return scored.select("image_id", "label", softmax("logits").alias("probs"))

    @cached_property
    def probs(self) -> DataFrame:
        """(image_id, label, class, p): the same in long form."""
        rows = self.prob_rows.select("image_id", "label", F.posexplode("probs").alias("class", "p"))
        return rows.withColumn("class", F.col("class").cast("bigint"))

    # archives, labels, logs ----------------------------------------------------------
    @cached_property
    def documents_by_shard(self) -> DataFrame:
        """(shard, key, n_chars, doc_id): twenty samples per shard."""
        return self.table("documents").select(
            F.floor(F.col("doc_id") / 20).alias("shard"),
            F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"),
            "n_chars",
            "doc_id",
        )

    @cached_property
    def members(self) -> DataFrame:
        """(shard, key, ext): the members of every sample archive."""
        # The extensions of a token sample.
        always = F.array(F.lit("code_indices.npy"), F.lit("lod_indices.npy"))
        docs = self.documents_by_shard
        labelled = self.table("labels").select(F.col("doc_id").alias("_doc"), F.lit(1).alias("_has"))
        labelled = labelled.dropDuplicates(["_doc"])
        rows = docs.join(labelled, docs["doc_id"] == labelled["_doc"], "left")
        patch = F.when(F.col("n_chars") % 97 != 0, F.array(F.lit("patch_indices.npy")))
        cls = F.when(F.col("_has") == 1, F.array(F.lit("cls")))
        none = F.array().cast("array<string>")
        exts = F.concat(always, F.coalesce(patch, none), F.coalesce(cls, none))
        return rows.select("shard", "key", F.explode(exts).alias("ext"))

    @cached_property
    def raw_labels(self) -> DataFrame:
        """(key, label_str): label texts, some of them unknown to the dictionary."""
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
        unknown = F.col("s_suppkey") % 13 == 0
        return rows.select(
            F.col("s_suppkey").alias("key"),
            F.when(unknown, F.lit("unknown")).otherwise(F.col("n_name")).alias("label_str"),
        )

    @cached_property
    def dictionary(self) -> DataFrame:
        """(name, idx): the label dictionary."""
        return self.table("nation").select(
            F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("idx")
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        """(run, event_id, line): training log text."""
        return log_text(self.table("events"))

    @cached_property
    def boxes(self) -> DataFrame:
        """(image_id, category_id, x, y, w, h, px, score, lk...): truth box and detection."""
        li = self.table("lineitem")
        x = F.col("l_quantity").cast("bigint") * 2
        return li.select(
            F.col("l_orderkey").alias("image_id"),
            F.pmod("l_suppkey", F.lit(3)).alias("category_id"),
            x.alias("x"),
            (F.col("l_linenumber").cast("bigint") * 10).alias("y"),
            (F.col("l_partkey") % 30 + 20).alias("w"),
            (F.col("l_suppkey") % 20 + 20).alias("h"),
            (x + F.col("l_partkey") % 7).alias("px"),
            ((F.col("l_partkey") % 100) / F.lit(100.0)).alias("score"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def numbered_boxes(self) -> DataFrame:
        cols = ["image_id", "category_id", "x", "y", "w", "h", "score", "price"]
        return number_rows(self.boxes, [], cols, "det_id")

    @cached_property
    def truth_boxes(self) -> DataFrame:
        """(det_id, image_id, category_id, x, y, w, h), numbered over all columns."""
        return self.numbered_boxes.select("det_id", "image_id", "category_id", "x", "y", "w", "h")

    @cached_property
    def detections(self) -> DataFrame:
        """(det_id, image_id, category_id, x, y, w, h, score), same numbering."""
        return self.numbered_boxes.select(
            "det_id", "image_id", "category_id", F.col("px").alias("x"), "y", "w", "h", "score"
        )

    # quadtrees -----------------------------------------------------------------------
    @cached_property
    def tree_ids(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("tree_id"))

    @cached_property
    def trees(self) -> DataFrame:
        """(tree_id, lod, patch): one random tree per customer."""
        return tree_ops.probabilistic_trees(self.tree_ids, GUARANTEED_DEPTH, GROWTH)

    def gain(self) -> Column:
        """Score of splitting a node, in [-0.5, 0.5)."""
        return uniform(F.lit("gain"), "tree_id", "lod", "patch") - 0.5


def log_text(events: DataFrame) -> DataFrame:
    """Format events as training log lines, all numbers from integers."""
    cents = F.floor(F.col("value") * 100 + 0.5)
    eid = F.col("event_id")

    def frac(c: Column, digits: int) -> Column:
        return F.lpad(F.pmod(c, F.lit(10**digits)).cast("string"), digits, "0")

    line = F.concat(
        F.lit("["),
        F.date_format("ts", "MM/dd HH:mm:ss"),
        F.lit(" train]: Data (t): 0."),
        frac(eid, 4),
        F.lit(", "),
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        frac(cents, 2),
        F.lit("/s/gpu Batch (t): 0."),
        frac(eid * 7, 4),
        F.lit(" LR: 0.000100 Step: "),
        eid.cast("string"),
        F.lit(" Loss: 6."),
        frac(eid * 13, 4),
    )
    return events.select(F.col("user_id").alias("run"), "event_id", line.alias("line"))
