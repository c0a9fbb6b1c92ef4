"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its five-word shingles. BagMinHash: every shingle has Poisson
processes over the levels of its weight, here its count; a point at a level counts for a text
if the text holds the shingle at least that often. Levels are arranged in dyadic layers
(0, 1], (1, 2], (2, 4], ... with a process each, so a heavy shingle costs the logarithm of its
weight. Each point falls on one signature component, which keeps the earliest. Two texts
agree in a component with a probability equal to their weighted Jaccard similarity. Points
later than all components of a text are never made, which makes the cost per shingle about
one point.

Candidates and links:

1. Texts that share a band of the signature share a bucket, cut by the sizes of the sets.
   Equal texts are one node.
2. In each bucket all texts are compared with one leader, the one whose buckets hold the most
   texts in all: the original of a large group of copies. Components follow.
3. In buckets whose other texts still belong to several components, the texts outside the
   largest are compared with all others, in blocks of bounded size per task.
   A task returns one link per text and component it joins, never all pairs. So every pair
   of a bucket is either verified or already in one component.

Verification is exact: the overlap of both multisets over their union, from whole texts.

Defined cases: a null text is a class of its own; texts without words are in a class only
with equal texts; a text of fewer than five words is one shingle; repeated rows are exact
copies; the class id is the least id of its documents, null if they have none; an empty table
gives an empty table; columns named like the results are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.components import roots
from tesserae.llm.names import fresh
from tesserae.session import materialise

SIMILARITY = 0.8
#: 1 - (1 - 0.8**5)**24: all but 7 in 100,000 pairs at the threshold share a band.
BANDS, BAND_ROWS = 24, 5
#: Shingles of the texts of one block; a task compares two blocks at a time.
BLOCK_SHINGLES = 400_000

#: Columns that name a bucket: its band, the key of the band, and a class of sizes.
BUCKET = ["band", "key", "level"]

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = np.uint64(0xC2B2AE3D27D4EB4F)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, count: int, size: int) -> np.ndarray:
    """BagMinHash of ``count`` weighted sets: (count, size) times, infinite for an empty set."""
    out = np.full(count * size, np.inf)
    # One entry per shingle and layer of levels that its weight reaches.
    layers = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(row)), layers)
    layer = np.arange(len(which)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer > 0, 1 << np.maximum(layer - 1, 0), 0).astype(float)
    width = np.maximum(low, 1.0)
    seed = texts.mix(shingle[which] + layer.astype(np.uint64) * _SPLIT)
    reach, owner = weight[which].astype(float), row[which]
    time = np.zeros(len(which))
    step = 0
    while len(which):
        step += 1
        draw = texts.mix(seed + np.uint64((step * int(_STEP)) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (width * size)
        other = texts.mix(draw ^ _SPLIT)
        level = low + (other >> np.uint64(32)).astype(float) * 2.0**-32 * width
        slot = owner * size + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
        counts = level < reach
        np.minimum.at(out, slot[counts], time[counts])
        latest = out.reshape(count, size).max(1)
        active = np.flatnonzero(time <= latest[owner])
        which, seed, low, width = which[active], seed[active], low[active], width[active]
        reach, owner, time = reach[active], owner[active], time[active]
    return out.reshape(count, size)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _SPLIT
    key = np.repeat(key, len(signature), axis=0)
    for j in range(bits.shape[2]):
        key = texts.mix(key * _STEP + bits[:, :, j])
    return key


def _weighted(part: texts.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of a chunk."""
    words = texts.words(part)
    row, shingle = texts.shingles(words.row, texts.hashes(part, words), part.count)
    row, shingle, count, _ = texts.tally(row, shingle)
    return row, shingle, count


def _keys_of(part: texts.Texts) -> dict:
    row, shingle, count = _weighted(part)
    has = np.bincount(row, minlength=part.count) > 0
    keys = band_keys(signatures(row, shingle, count, part.count, BANDS * BAND_ROWS)).view(np.int64)
    size = np.bincount(row, weights=count, minlength=part.count).astype(np.int64)
    return {"keys": [k if h else k[:0] for k, h in zip(keys, has)], "size": size}


def overlaps(left: texts.Texts, right: texts.Texts) -> np.ndarray:
    """Weighted Jaccard similarity of text i of ``left`` and text i of ``right``."""
    size = [np.zeros(left.count), np.zeros(left.count)]
    tables = []
    for side, part in enumerate((left, right)):
        row, shingle, count = _weighted(part)
        size[side] = np.bincount(row, weights=count, minlength=left.count)
        key = texts.mix(shingle ^ texts.mix(row.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        tables.append((key[order], row[order], count[order]))
    (ka, ra, ca), (kb, _, cb) = tables
    if not len(ka) or not len(kb):
        return np.zeros(left.count)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    common = np.bincount(ra[both], weights=np.minimum(ca[both], cb[at[both]]), minlength=left.count)
    union = size[0] + size[1] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        # Both sides are cut at the same rows: the longer text of a pair counts.
        first = 0
        size = np.maximum(*[np.array([len(t) for t in batch.column(i).to_pylist()], dtype=np.int64) for i in (2, 3)])
        total = np.cumsum(size)
        while first < batch.num_rows:
            last = int(np.searchsorted(total, (total[first - 1] if first else 0) + texts.CHUNK_BYTES // 4, side="right"))
            last = max(last, first + 1)
            sides = [next(texts.chunks(batch.column(i).slice(first, last - first), 1 << 62)) for i in (2, 3)]
            good = pa.array(overlaps(*sides) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays(
                [a.slice(first, last - first).filter(good), b.slice(first, last - first).filter(good)], names=["a", "b"]
            )
            first = last


def _components_within(group: pd.DataFrame) -> pd.DataFrame:
    """Links between components of one block pair: rows marked ``probe`` against all rows.

    A pair that met in an earlier band or size class is left to that.
    """
    part = next(texts.chunks(pa.array(group["text"], pa.string()), 1 << 62))
    row, shingle, count = _weighted(part)
    order = np.argsort(row, kind="stable")
    row, count = row[order], count[order].astype(float)
    vocabulary, code = np.unique(shingle[order], return_inverse=True)
    n = part.count
    size = np.bincount(row, weights=count, minlength=n)
    begin = np.searchsorted(row, np.arange(n + 1))
    labels, component = np.unique(group["root"].map(bytes).to_numpy(), return_inverse=True)
    parent = np.arange(len(labels))
    earlier = np.stack(group["keys"].to_list())[:, : int(group["band"].iloc[0])]
    # Two texts that are both here from the class below have met there.
    up = group["up"].to_numpy()
    made = []
    ids = group["tid"].map(bytes).to_numpy()
    weight = np.zeros(len(vocabulary))
    for i in np.flatnonzero(group["probe"].to_numpy()):
        # Texts of very different sizes can't be that similar.
        able = (parent[component] != parent[component[i]]) & (size >= SIMILARITY * size[i]) & (size[i] >= SIMILARITY * size)
        if up[i]:
            able &= ~up
        near = np.flatnonzero(able)
        near = near[~(earlier[near] == earlier[i]).any(1)]
        if not len(near):
            continue
        own = slice(begin[i], begin[i + 1])
        weight[code[own]] = count[own]
        which, at = texts.expand(begin[near], begin[near + 1])
        common = np.bincount(which, weights=np.minimum(count[at], weight[code[at]]), minlength=len(near))
        weight[code[own]] = 0
        similar = common >= SIMILARITY * (size[near] + size[i] - common) - 1e-9
        for j in near[similar]:
            mine, theirs = parent[component[i]], parent[component[j]]
            if theirs != mine:
                made.append((ids[i], ids[j]))
                parent[parent == theirs] = mine
    return pd.DataFrame(made, columns=["a", "b"])


def links(docs: DataFrame, tid: str, text: str) -> DataFrame:
    """(node, root) of all distinct texts that are linked to a different text."""
    source = docs.filter(F.col(tid).isNotNull()).select(F.col(tid).alias("tid"), F.col(text).alias("text"))
    keys = texts.map_texts(source, "text", ["tid"], "keys array<bigint>, size bigint", _keys_of)
    keys = materialise(keys.dropDuplicates(["tid"]))
    rows = keys.select("tid", "size", F.posexplode("keys").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Sets that differ much in size can't be similar: a bucket is cut into size classes, and
    # each text is in its own and the next, so that sizes within 1 / SIMILARITY always meet.
    level = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9).cast("int")
    members = materialise(rows.join(sizes, ["band", "key"]).select("tid", "band", "key", level.alias("level")))
    both = F.array(F.struct("level", F.lit(False).alias("up")), F.struct((F.col("level") + 1).alias("level"), F.lit(True).alias("up")))
    members = members.select("tid", "band", "key", F.inline(both))
    sizes = members.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(members.join(sizes, BUCKET))
    # Leaders: texts in the fullest buckets.
    central = members.groupBy("tid").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "tid").groupBy(*BUCKET).agg(F.max(F.struct("central", "tid"))["tid"].alias("leader"))
    members = materialise(members.join(leaders, BUCKET))
    pairs = members.filter("tid <> leader").select(F.col("leader").alias("a"), F.col("tid").alias("b")).distinct()
    # One text of each node that is in a bucket.
    wanted = members.select("tid").distinct()
    bodies = materialise(source.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")).join(keys, "tid"))
    one, other = (bodies.select(F.col("tid").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    compared = pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    verified = materialise(compared.mapInArrow(_verify, "a binary, b binary"))
    found = roots(verified)

    # What is left: buckets whose texts other than the leader are in several components.
    placed = members.filter("tid <> leader").join(found, members["tid"] == found["node"], "left")
    placed = placed.withColumn("root", F.coalesce("root", "tid")).select(*BUCKET, "tid", "up", "root")
    placed = placed.join(bodies.select("tid", "size"), "tid")
    open_keys = placed.groupBy(*BUCKET).agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("up").alias("up"), F.sum("size").alias("n")
    )
    open_keys = open_keys.filter("lo <> hi AND NOT up").select(*BUCKET, "n")
    left = materialise(placed.join(open_keys, BUCKET))
    if left.isEmpty():
        return found
    main = left.groupBy(*BUCKET, "root").agg(F.count(F.lit(1)).alias("m"))
    main = main.groupBy(*BUCKET).agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    left = left.join(main, BUCKET)
    blocks = F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int")
    mine = F.pmod(F.xxhash64("tid"), blocks).cast("int")
    # Rows of the largest component and all others meet each block of the others.
    rows = left.withColumns({"block": mine, "probe": F.col("root") != F.col("main"), "blocks": blocks})
    as_all = rows.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(False))
    as_probe = rows.filter("probe AND blocks > 1").withColumnRenamed("block", "other")
    as_probe = as_probe.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = rows.filter("blocks = 1").withColumn("other", F.lit(0))
    cells = small.unionByName(as_all).unionByName(as_probe).select(*BUCKET, "block", "other", "tid", "up", "root", "probe")
    # A cell without a probe has nothing to compare.
    busy = cells.groupBy(*BUCKET, "block", "other").agg(F.max("probe").alias("p")).filter("p").drop("p")
    cells = cells.join(busy, [*BUCKET, "block", "other"]).join(bodies, "tid")
    more = cells.groupBy(*BUCKET, "block", "other").applyInPandas(_components_within, "a binary, b binary")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return roots(materialise(edges))


def text_id(text):
    """Identity of a text: 128 bits of its content, null for null."""
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "class_id") -> DataFrame:
    """Add ``name``, the least ``key`` of the documents near a document (its own without any), and ``class_size``."""
    docs = docs.drop(name, "class_size")
    tid, root = fresh(docs, "tid"), fresh(docs, "root")
    tagged = docs.withColumn(tid, text_id(F.col(f"`{text}`").cast("string")))
    ids = tagged.select(F.col(f"`{key}`").alias("k"), F.col(tid).alias("tid"))
    found = links(tagged, tid, text)
    placed = ids.filter("tid IS NOT NULL").groupBy("tid").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    placed = placed.join(found, placed["tid"] == found["node"], "left").select("tid", "k", "n", F.coalesce("root", "tid").alias("root"))
    placed = materialise(placed)
    firsts = placed.groupBy("root").agg(F.min("k").alias(name), F.sum("n").alias("class_size"))
    table = placed.select(F.col("tid").alias(root), F.col("root")).join(firsts, "root").drop("root")
    out = tagged.join(table, tagged[tid] == table[root], "left").drop(root)
    lone = F.col(tid).isNull()
    return out.withColumns(
        {
            name: F.when(lone, F.col(f"`{key}`")).otherwise(F.col(f"`{name}`")),
            "class_size": F.when(lone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint"),
        }
    ).drop(tid)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the least key, any one of those that repeat it. Null texts all stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(whole, F.col(f"`{key}`").alias("key"), body.alias("text"), text_id(body).alias("tid"))
    found = links(rows, "tid", "text")
    ids = rows.filter("tid IS NOT NULL").groupBy("tid", "key").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.join(found, ids["tid"] == found["node"], "left").withColumn("root", F.coalesce("root", "tid"))
    # Least key first, null keys last, then the least text.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid", "n"))
    chosen = materialise(ids.groupBy("root").agg(first.alias("f")).select(F.col("f.tid").alias("t"), F.col("f.key").alias("k"), "f.n"))
    same = (rows["tid"] == chosen["t"]) & rows["key"].eqNullSafe(chosen["k"])
    kept = rows.select("row", "tid", "key").join(chosen, same)
    once = kept.filter("n = 1").select("row")
    # Rows that repeat key and text: any one of them.
    again = kept.filter("n > 1").select("tid", "row").dropDuplicates(["tid"]).select("row")
    return rows.filter("tid IS NULL").select("row").unionByName(once).unionByName(again).select("row.*")
