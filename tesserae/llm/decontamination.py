"""Benchmark passages in documents, found by SimHash fingerprints of item-sized windows.

For every benchmark item, windows of as many words as the item slide over every document, one
word at a time. A window's fingerprint is the SimHash of its five-word shingles, each weighing
as often as it occurs. An index finds all items of that length within a Hamming radius: the 64
bits are cut into blocks, and a pair within the radius differs in few bits of at least one
block, so all near values of every block are indexed and no pair within the radius is lost.
Pairs found are verified by the exact weighted Jaccard similarity of their shingles.

A window without a single shingle of an item has similarity 0 to all items, so fingerprints
are made only of windows that hold one; that skips work and no result.

Items are the stated query set. They are sent to the tasks in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, with one pass over the documents per block.

Defined cases: words are compared without ASCII case; null and empty texts and items match
nothing; an item of fewer than five words is one shingle; equal items and equal documents are
each reported; documents shorter than an item do not match it; an empty table of items
matches nothing; an item with a null id is reported with a null id; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.names import fresh

SIMILARITY = 0.8
#: Hamming radius. The fingerprints of two windows of similarity 0.8 differ in about 10 of 64
#: bits with a deviation of 3, so one pair in thousands lies outside.
RADIUS = 20
#: Blocks of the index; a pair within the radius has at most RADIUS // BLOCKS differing bits in one.
BLOCKS = 7
BLOCK_ITEMS = 4000
BLOCK_WORDS = 1_000_000

MATCH = "array<struct<item_id: bigint, start: bigint, words: bigint, distance: int, similarity: double>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BIT_EDGES = [64 * b // BLOCKS for b in range(BLOCKS + 1)]


def word_hashes(part: texts.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words, without ASCII case."""
    part = texts.Texts(_LOWER[part.data], part.offsets, part.first)
    words = texts.words(part)
    return words.row, texts.hashes(part, words)


def fingerprints(shingle: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``count`` consecutive shingles from each start: the sign of every bit's balance."""
    bits = np.unpackbits(shingle.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[start + count] - total[start]
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _block(value: np.ndarray, block: int) -> np.ndarray:
    low, high = _BIT_EDGES[block], _BIT_EDGES[block + 1]
    return ((value >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def _near(bits: int) -> np.ndarray:
    """Masks of all ways to flip at most RADIUS // BLOCKS of ``bits`` bits."""
    masks = [0]
    for n in range(1, RADIUS // BLOCKS + 1):
        masks += [sum(1 << b for b in flips) for flips in combinations(range(bits), n)]
    return np.array(masks, dtype=np.int64)


@dataclass
class Index:
    """Benchmark items as arrays: per item its length, and what the searches look up, sorted."""

    ids: list
    length: np.ndarray
    print: np.ndarray
    shingle: np.ndarray  # distinct shingles of all items
    shingle_items: np.ndarray  # items of each, from shingle_from[i] on
    shingle_from: np.ndarray
    pair: np.ndarray  # hashed (item, shingle)
    pair_count: np.ndarray
    key: np.ndarray  # (length, block, value) of every near value
    key_item: np.ndarray


def _pair_key(item: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    return texts.mix(shingle ^ texts.mix(item.astype(np.uint64) + np.uint64(1)))


def _index_key(length: np.ndarray, block: int, value: np.ndarray) -> np.ndarray:
    return ((length * BLOCKS + block) << 16) | value


def build(items: Sequence[tuple[int | None, str | None]]) -> Index:
    items = [(i, t) for i, t in items if t]
    rows, prints, lengths, ids = [], [], [], []
    for i, text in items:
        part = next(texts.chunks(pa.array([text])))
        row, value = word_hashes(part)
        if not len(value):
            continue
        _, shingle = texts.shingles(row, value, 1)
        ids.append(i)
        lengths.append(len(value))
        prints.append(fingerprints(shingle, np.array([0]), len(shingle))[0])
        rows.append(shingle)
    length, mark = np.array(lengths, dtype=np.int64), np.array(prints, dtype=np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
    shingle = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    pair, count = np.unique(_pair_key(owner, shingle), return_counts=True)
    once = np.unique(np.stack([shingle, owner.astype(np.uint64)]), axis=1) if len(shingle) else np.zeros((2, 0), np.uint64)
    distinct, begin = np.unique(once[0], return_index=True)
    keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in range(BLOCKS):
        masks = _near(_BIT_EDGES[b + 1] - _BIT_EDGES[b])
        near = _block(mark, b)[:, None] ^ masks
        keys.append(_index_key(np.repeat(length, len(masks)), b, near.reshape(-1)))
        owners.append(np.repeat(np.arange(len(mark)), len(masks)))
    key, key_item = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    return Index(
        ids, length, mark, distinct, once[1].astype(np.int64), np.append(begin, once.shape[1]), pair, count, key[order], key_item[order]
    )


def _lookup(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Position of each value in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(value), -1)
    at = np.minimum(np.searchsorted(table, value), len(table) - 1)
    return np.where(table[at] == value, at, -1)


def _windows(index: Index, row: np.ndarray, shingle: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position among the shingles, item length) of all windows that hold a shingle of an item of that length."""
    rare = np.zeros(1 << 16, dtype=bool)
    rare[(index.shingle & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(rare[(shingle & np.uint64(0xFFFF)).astype(np.int64)])
    found = _lookup(index.shingle, shingle[maybe])
    maybe, found = maybe[found >= 0], found[found >= 0]
    which, at = texts.expand(index.shingle_from[found], index.shingle_from[found + 1])
    length = index.length[index.shingle_items[at]]
    fits = np.minimum(length, texts.SHINGLE_WORDS) == size
    anchors = np.unique(np.stack([maybe[which][fits], length[fits]]), axis=1)
    count = anchors[1] - size + 1
    which, start = texts.expand(np.maximum(anchors[0] - count + 1, 0), anchors[0] + 1)
    length = anchors[1][which]
    last = start + length - size
    inside = last < len(shingle)
    start, length, last = start[inside], length[inside], last[inside]
    inside = row[start] == row[last]
    start, length = np.unique(np.stack([start[inside], length[inside]]), axis=1)
    return start, length


def search(part: texts.Texts, index: Index) -> list[list[dict]]:
    """Matches of every text, best window of each item, in order of items."""
    out: list[list[dict]] = [[] for _ in range(part.count)]
    if not len(index.length):
        return out
    row, value = word_hashes(part)
    first_word = np.searchsorted(row, np.arange(part.count))
    for size in sorted({min(int(n), texts.SHINGLE_WORDS) for n in index.length}):
        place, shingle = texts.windows(row, value, size)
        owner = row[place]
        start, length = _windows(index, owner, shingle, size)
        for n in np.unique(length):
            _match(out, index, start[length == n], int(n), size, place, owner, shingle, first_word)
    for found in out:
        found.sort(key=lambda m: (m["item_id"] is None, m["item_id"]))
    return out


def _match(out, index, start, n, size, place, owner, shingle, first_word) -> None:
    count = n - size + 1
    # Only the stretches with windows are summed up.
    which, at = texts.expand(start, start + count)
    needed = np.unique(at)
    mark = fingerprints(shingle[needed], np.searchsorted(needed, start), count)
    hits = []
    for b in range(BLOCKS):
        key = _index_key(np.full(len(mark), n), b, _block(mark, b))
        window, entry = texts.expand(np.searchsorted(index.key, key, "left"), np.searchsorted(index.key, key, "right"))
        hits.append(window * len(index.length) + index.key_item[entry])
    window, item = np.divmod(np.unique(np.concatenate(hits)), len(index.length))
    distance = np.bitwise_count(mark[window] ^ index.print[item]).astype(np.int64)
    near = distance <= RADIUS
    window, item, distance = window[near], item[near], distance[near]
    if not len(window):
        return
    # Weighted overlap: the smaller of both counts of every distinct shingle of a window.
    pair, at = texts.expand(start[window], start[window] + count)
    pair, distinct, often, _ = texts.tally(pair, shingle[at])
    known = _lookup(index.pair, _pair_key(item[pair], distinct))
    common = np.where(known >= 0, np.minimum(often, index.pair_count[known]), 0)
    overlap = np.bincount(pair, weights=common, minlength=len(window))
    similarity = overlap / (2 * count - overlap)
    good = np.flatnonzero(similarity >= SIMILARITY)
    text = owner[start[window]]
    best: dict[tuple[int, int], int] = {}
    for i in good:
        slot = (int(text[i]), int(item[i]))
        if slot not in best or similarity[i] > similarity[best[slot]]:
            best[slot] = i
    for (t, j), i in best.items():
        out[t].append(
            {
                "item_id": index.ids[j],
                "start": int(place[start[window[i]]] - first_word[t]),
                "words": n,
                "distance": int(distance[i]),
                "similarity": float(similarity[i]),
            }
        )


def with_matches(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", name: str = "matches") -> DataFrame:
    """Add ``name``, the matches of every document (an empty array for clean ones), replacing a column of that name."""
    docs = docs.drop(name)
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(texts.word_count(F.col("t"))), F.lit(0)).alias("w")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["w"] // BLOCK_WORDS))
    out = docs
    spark = docs.sparkSession
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in rows]))
        column = fresh(docs, f"{name}_{b}")
        parts.append(column)
        out = _searched(out, shared, text, column)
    joined = F.concat(*[F.col(f"`{p}`") for p in parts])
    return out.withColumn(name, joined).drop(*parts)


def _searched(docs: DataFrame, shared, text: str, column: str) -> DataFrame:
    @F.pandas_udf(MATCH)
    def find(column: pd.Series) -> pd.Series:
        made = []
        for part in texts.chunks(pa.array(column, pa.string())):
            made.extend(search(part, shared.value))
        return pd.Series(made)

    return docs.withColumn(column, find(F.col(f"`{text}`")))
