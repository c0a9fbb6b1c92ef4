"""Near-duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

The fingerprint of a text has a bit set where more than half of the hashes of its four-word
shingles have it, repeats included. Two fingerprints link at ``RADIUS`` or fewer differing
bits. The 64 bits are cut into ``n`` blocks; ``RADIUS`` differing bits touch at most ``RADIUS``
blocks, so a close pair shares the other ``n - RADIUS`` blocks whole. One key for each choice of
so many blocks therefore brings every close pair together, and the distance is then verified.
More blocks make longer and more keys: ``plan`` takes the fewest for which unrelated
fingerprints hardly share a key, whatever their number.

Equal fingerprints are one node, so copies never multiply. Keys of more than ``HOT`` different
fingerprints (large groups of near-copies) are not compared pair by pair: two fingerprints differ
in at most 4 bits just if some value differs in at most 2 from both, so each such fingerprint
is linked to all values within 2 of it, and values reached twice connect their fingerprints. That
takes 2,081 rows a fingerprint, whatever the size of the group, and finds the same components.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other; a text of fewer than four words is one shingle; rows that repeat an id or a
text are nodes of their own that link by their fingerprint; the component id is the least id that is
not null, null if there is none; an empty table gives an empty table; other columns are kept,
those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.components import roots
from tesserae.llm.names import fresh
from tesserae.session import broadcast_if_small, materialise

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fewest and most blocks: 35 keys of 27 bits, 210 keys of 36 bits.
LEAST_BLOCKS, MOST_BLOCKS = 7, 10
#: A key of more different fingerprints is joined by the values between them.
HOT = 256
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _plain(part: texts.Texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words in lower case with one space after each: (bytes, starts, ends, text of each)."""
    words = texts.words(part)
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    # Runs of single spaces are copied as they are: only words move.
    shift = np.repeat(words.start - start, size)
    place = np.ones(len(out), dtype=bool)
    place[end] = False
    at = np.flatnonzero(place)
    out[at] = _LOWER[part.data[at + shift]]
    return out.tobytes(), start, end, words.row


def fingerprints(part: texts.Texts) -> np.ndarray:
    """Fingerprint of every text of a chunk."""
    body, start, end, row = _plain(part)
    count = np.bincount(row, minlength=part.count)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - SHINGLE_WORDS + 1, 1), 0)
    owner, at = texts.expand(first, first + shingles)
    last = at + np.minimum(count[owner], SHINGLE_WORDS) - 1
    ones = np.zeros((part.count, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(at), SLICE):
        cut = slice(low, low + SLICE)
        pairs = zip(start[at[cut]].tolist(), end[last[cut]].tolist())
        value = np.fromiter((digest(body[a:b], SEED) for a, b in pairs), dtype="<u8", count=len(at[cut]))
        bits = np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[cut]
        begin = np.flatnonzero(np.diff(mine, prepend=-1))
        ones[mine[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add ``name``, the fingerprint of ``text`` as a bigint, replacing a column of that name."""
    docs = docs.drop(name)
    made = fresh(docs, "made")
    out = texts.map_texts(docs, text, docs.columns, f"{made} bigint", lambda part: {made: fingerprints(part).view(np.int64)})
    return out.withColumnRenamed(made, name)


def edges_of(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of every block."""
    cut = [64 * b // blocks for b in range(blocks + 1)]
    return [(low, high - low) for low, high in zip(cut, cut[1:])]


def plan(count: int) -> list[int]:
    """Masks of the bits of each key for ``count`` different fingerprints."""
    for blocks in range(LEAST_BLOCKS, MOST_BLOCKS + 1):
        widths = edges_of(blocks)
        chosen = list(combinations(widths, blocks - RADIUS))
        if min(sum(w for _, w in c) for c in chosen) >= count.bit_length() + 2:
            break
    return [sum(((1 << w) - 1) << low for low, w in c) for c in chosen]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(table, key, fp): every fingerprint under each of its keys."""
    made = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]
    return nodes.select("fp", F.inline(F.array(*made))).select("table", "key", "fp")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, fp) of all values within two bits of a fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = reduce(lambda out, i: [*out, one[i] | one[i + 1 :]], range(63), [])
    flips = np.concatenate([np.zeros(1, np.uint64), one, *two])
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            fp = batch.column(0).slice(low, 256).to_numpy(zero_copy_only=False).view(np.uint64)
            values = (fp[:, None] ^ flips).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(flips)))], names=["value", "fp"]
            )


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) links between different fingerprints ``fp``, enough to connect all that are close.

    ``nodes`` holds every fingerprint once.
    """
    masks = plan(nodes.count())
    keys = _keys(nodes, masks)
    sizes = materialise(keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = materialise(keys.join(broadcast_if_small(sizes), ["table", "key"]))
    some = shared.filter(F.col("n") <= HOT).select("table", "key", "fp")
    left, right = some.withColumnRenamed("fp", "a"), some.withColumnRenamed("fp", "b")
    pairs = left.join(right, ["table", "key"]).filter("a < b").filter(_distance(F.col("a"), F.col("b")) <= RADIUS)
    near = pairs.select("a", "b").distinct()
    hot = shared.filter(F.col("n") > HOT).select("fp").distinct()
    between = materialise(hot).mapInArrow(_balls, "value bigint, fp bigint")
    met = between.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    # Values reached by three or more link all of them to the least.
    pairs_met = met.filter("n = 2").select("a", "b").distinct()
    more = met.filter("n > 2").select("value", "a")
    rest = between.join(more, "value").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return near.unionByName(pairs_met).unionByName(rest)


def classes(rows: DataFrame, fingerprint: str, key: str = "doc_id", name: str = "component_id") -> DataFrame:
    """Add ``name``, the least ``key`` of all rows whose ``fingerprint`` (bigint) is reachable by links.

    ``rows`` is read twice; store it where making it is dear.
    """
    rows = rows.drop(name)
    ids, mark = F.col(f"`{key}`"), F.col(f"`{fingerprint}`")
    nodes = materialise(rows.groupBy(mark.alias("fp")).agg(F.min(ids).alias("first"), F.count(F.lit(1)).alias("n")))
    found = roots(materialise(links(nodes.select("fp"))))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left")
    linked = placed.filter("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    whole = linked.select("fp", "root").join(least, "root").select("fp", "least")
    # A fingerprint that one document has alone needs no look-up.
    copied = placed.filter("root IS NULL AND n > 1").select("fp", F.col("first").alias("least"))
    target = materialise(whole.unionByName(copied).select(F.struct("fp", "least").alias(fresh(rows, "target"))))
    target = broadcast_if_small(target)
    found_row = F.col(target.columns[0])
    out = rows.join(target, mark == found_row["fp"], "left")
    return out.withColumn(name, F.when(found_row.isNull(), ids).otherwise(found_row["least"])).drop(target.columns[0])


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "component_id") -> DataFrame:
    """Add ``fingerprint`` (16 hexadecimal digits) and ``name``, the least ``key`` of all documents reachable by links."""
    rows = materialise(with_fingerprint(docs, text))
    return classes(rows, "fingerprint", key, name).withColumn("fingerprint", shown(F.col("fingerprint")))


def shown(fingerprint: Column) -> Column:
    """The sixteen lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
