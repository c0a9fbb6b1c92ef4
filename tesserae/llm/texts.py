"""Words, lines and shingles of whole Arrow text columns, computed with numpy inside tasks.

A word is a maximal run of characters other than space and U+0009 to U+000D. All functions
work on the UTF-8 bytes of many texts at once, so no Python object is made per word. Chunks
are bounded by bytes, which bounds the memory of a task whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.names import fresh

#: Bytes of text worked on at a time; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Words of a shingle wherever near-duplicates are concerned.
SHINGLE_WORDS = 5
#: The word pattern for SQL and Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _is_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_SPACE = _is_space()
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)


@dataclass
class Texts:
    """Some texts: their bytes back to back, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text satisfy ``mask``."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Spans:
    """Disjoint byte ranges in ascending order and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, budget: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a text column into runs of rows of at most ``budget`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def words(texts: Texts) -> Spans:
    """All words of all texts."""
    solid = ~_SPACE[texts.data]
    filled = texts.offsets[1:] > texts.offsets[:-1]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    head, tail = texts.offsets[:-1][filled], texts.offsets[1:][filled] - 1
    opens[head] = solid[head]
    closes[tail] = solid[tail]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Spans(start, end, np.searchsorted(texts.offsets, start, side="right") - 1)


def lines(texts: Texts) -> Spans:
    """All lines, split at U+000A; an empty text has one empty line."""
    breaks = np.flatnonzero(texts.data == 10)
    inside = np.searchsorted(texts.offsets, breaks, side="right") - 1
    row = np.concatenate([np.arange(texts.count), inside])
    start = np.concatenate([texts.offsets[:-1], breaks + 1])
    end = np.concatenate([texts.offsets[1:], breaks])
    return Spans(start[np.lexsort((start, row))], end[np.lexsort((end, row))], np.sort(row))


def hashes(texts: Texts, spans: Spans, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    size = (spans.end - spans.start).astype(np.int64)
    out = np.zeros(len(size), dtype=np.uint64)
    filled = np.flatnonzero(size > 0)
    if len(filled):
        n = size[filled]
        stop = np.cumsum(n)
        begin = stop - n
        place = np.arange(stop[-1])
        within = place - np.repeat(begin, n)
        power = np.full(int(n.max()), _STEP, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        value = _BYTE[texts.data[np.repeat(spans.start[filled], n) + within]] * power[within]
        out[filled] = np.add.reduceat(value, begin)
    return mix(out + size.astype(np.uint64) * _GOLDEN + np.uint64(seed))


def windows(row: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of ``size`` words inside one text."""
    if len(value) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(value) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total = total * _STEP + value[j : j + n]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, mix(total[at] + np.uint64(size))


def shingles(row: np.ndarray, value: np.ndarray, texts: int, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer than ``size`` words has one, of all its words."""
    at, out = windows(row, value, size)
    owner = row[at]
    count = np.bincount(row, minlength=texts)
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return owner, out
    begin = np.searchsorted(row, short, side="left")
    total = np.zeros(len(short), dtype=np.uint64)
    for j in range(size - 1):
        inside = count[short] > j
        total[inside] = total[inside] * _STEP + value[begin[inside] + j]
    total = mix(total + count[short].astype(np.uint64))
    owner, out = np.concatenate([owner, short]), np.concatenate([out, total])
    order = np.argsort(owner, kind="stable")
    return owner[order], out[order]


def tally(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group equal (row, value), in no order: (rows, values, counts, group number of every input element)."""
    key = value ^ mix((row.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return row[order[at]], value[order[at]], np.diff(np.append(at, len(key))), group


def expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position of many ranges."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def map_texts(df: DataFrame, text: str, keep: list[str], schema: str, work: Callable[[Texts], dict]) -> DataFrame:
    """Apply ``work`` to all texts; its arrays become columns beside the ``keep`` columns.

    ``schema`` names the new columns; ``work`` returns one array of that length per name.
    """
    kept = [f.simpleString().split(":", 1) for f in df.select(*[F.col(f"`{k}`") for k in keep]).schema.fields]
    out_schema = ", ".join([f"`{n}` {t}" for n, t in kept] + [schema])
    names = [part.split()[0] for part in _top_level(schema)]
    body = fresh(df, "text")
    source = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias(body))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(body))
            for part in chunks(column):
                made = work(part)
                rows = batch.slice(part.first, part.count)
                arrays = [rows.column(i) for i in range(len(keep))] + [pa.array(made[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + names)

    return source.mapInArrow(task, out_schema)


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [s.strip() for s in out]


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("bigint")
