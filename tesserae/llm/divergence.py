"""Audit of how far sources of a language diverge in their use of words.

Indexing is single-pass in memory: a task reads its documents once and builds postings (language,
source, term, documents, occurrences) of exact terms until ``BLOCK_BYTES`` of them are held, then
spills them as a run sorted by term. Runs are dealt to shards by a hash of (language, term);
each shard merges its sorted runs term by term into frequencies, keeping one term at a time.

For two sources a and b of a language, with smoothed shares p of a and q of b in parts per
``SCALE``, the divergence is the sum of ``floor((p - q)**2 / q)`` over all kept terms. Most terms
occur in few sources, so the sum starts from the value of terms that neither has, and corrections
are added: per source from the histogram of its counts, and per pair from a stream of the terms
that both have. All arithmetic is in integers and exact.

A term with k sources makes k * k corrections, which are summed in the task in slices, so a task
holds a bounded number of them and returns one row a pair and slice.

Defined cases: null texts, languages and sources are read as empty; every row is a document, so
repeated rows count again; a source without terms, and a language without kept terms, are
reported with all pairs (value 0 where nothing is kept); ties order by item; an empty table gives an
empty table; other columns are ignored. Texts of any length are read in pieces cut between terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.session import broadcast_if_small, materialise

#: Parts that shares are counted in, documents a kept term needs, and ranks of terms reported.
SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Bytes of postings a task holds before it spills a run, and of text read at a time.
BLOCK_BYTES = 48 << 20
PIECE_BYTES = 1 << 20
#: Corrections worked on at a time.
SLICE = 1 << 20

_POSTING = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())]
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Postings ----------------------------------------------------------------------------------------


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, and the text of each."""
    solid = _LETTER[data]
    step = np.diff(solid.astype(np.int8), prepend=0)
    opens = step == 1
    # A text that begins with a letter opens a term even after another text's letter.
    head = offsets[:-1][offsets[1:] > offsets[:-1]]
    opens[head] = solid[head]
    start = np.flatnonzero(opens)
    owner = np.searchsorted(offsets, start, side="right") - 1
    # The end is the next place that is no letter, at most the text's end.
    gaps = np.flatnonzero(~solid)
    at = np.searchsorted(gaps, start)
    end = np.append(gaps, len(data))[at]
    end = np.minimum(end, offsets[owner + 1])
    body = _LOWER[data[solid]]
    size = np.concatenate([[0], np.cumsum(end - start)])
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(body)])
    return terms, owner


def _counted(group: np.ndarray, owner: np.ndarray, terms: pa.Array) -> pa.Table:
    """(group, term, docs, n) of terms; ``owner`` is the text of each, ``group`` the group of each text."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = max(len(coded.dictionary), 1)
    # Once per document and term, then once per group and term.
    pair, often = np.unique(owner * words + code, return_counts=True)
    key, inverse = np.unique(group[pair // words] * words + pair % words, return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, inverse, often.astype(np.int64))
    docs = np.bincount(inverse, minlength=len(key)).astype(np.int64)
    return pa.table({"group": key // words, "term": coded.dictionary.take(pa.array(key % words)), "docs": docs, "n": n})


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces, cut after a byte that is no letter."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data):
            gaps = np.flatnonzero(~_LETTER[data[end : end + PIECE_BYTES]])
            if len(gaps):
                end += int(gaps[0]) + 1
                break
            end += PIECE_BYTES
        yield data[at:end]
        at = end


def _long(data: np.ndarray, group: int) -> pa.Table:
    """Postings of one long text, which is one document for all its terms."""
    parts: list[pa.Table] = []
    for piece in _pieces(data):
        terms, owner = _terms(piece, np.array([0, len(piece)]))
        parts.append(_counted(np.array([group]), owner, terms))
        if len(parts) > 16:
            parts = [_summed(pa.concat_tables(parts))]
    out = _summed(pa.concat_tables(parts))
    return out.set_column(out.column_names.index("docs"), "docs", pa.array(np.ones(out.num_rows, dtype=np.int64)))


def _summed(table: pa.Table) -> pa.Table:
    keys = [c for c in table.column_names if c not in ("docs", "n")]
    out = table.group_by(keys, use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return out.rename_columns([*keys, "docs", "n"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to runs of postings, each sorted by language, term and source."""
    held: list[pa.Table] = []
    size = summed = 0

    def run() -> Iterator[pa.RecordBatch]:
        whole = _summed(pa.concat_tables(held)).select(_POSTING.names)
        yield from whole.sort_by([(c, "ascending") for c in ("lang", "term", "source")]).to_batches(max_chunksize=1 << 14)

    for batch in batches:
        names = pa.table({"lang": batch.column(0), "source": batch.column(1)})
        groups = names.group_by(["lang", "source"], use_threads=False).aggregate([])
        label = {pair: i for i, pair in enumerate(zip(*(groups[c].to_pylist() for c in ("lang", "source"))))}
        of_row = np.array([label[p] for p in zip(*(names[c].to_pylist() for c in ("lang", "source")))], dtype=np.int64)
        for part in texts.chunks(batch.column(2), PIECE_BYTES):
            mine = of_row[part.first : part.first + part.count]
            if len(part.data) > 2 * PIECE_BYTES and part.count == 1:
                made = _long(part.data, int(mine[0]))
            else:
                terms, owner = _terms(part.data, part.offsets)
                made = _counted(mine, owner, terms)
            named = groups.take(made["group"])
            made = pa.table([named["lang"], made["term"].cast(pa.string()), named["source"], made["docs"], made["n"]], schema=_POSTING)
            held.append(made)
            size += made.nbytes
        if size - summed > BLOCK_BYTES // 4:
            held = [_summed(pa.concat_tables(held)).select(_POSTING.names)]
            size = summed = held[0].nbytes
            if size > BLOCK_BYTES:
                yield from run()
                held, size, summed = [], 0, 0
    if held:
        yield from run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings of a shard to (lang, term, source, docs, n) summed over runs, a run of equal keys across batches included."""
    left: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch]).cast(_POSTING)
        if left is not None:
            whole = pa.concat_tables([left, whole])
        whole = whole.combine_chunks()
        new = _changes(whole)
        # The last key may go on in the next batch.
        first = int(new[-1])
        if first:
            yield from _reduced(whole.slice(0, first), new[:-1]).to_batches()
        left = _reduced(whole.slice(first), np.zeros(1, dtype=np.int64))
    if left is not None:
        yield from left.to_batches()


def _changes(table: pa.Table) -> np.ndarray:
    """First row of every run of equal (lang, term, source)."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in ("lang", "term", "source"):
        column = table[name].combine_chunks()
        other = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _reduced(table: pa.Table, first: np.ndarray) -> pa.Table:
    keys = table.select(["lang", "term", "source"]).take(pa.array(first))
    sums = [np.add.reduceat(table[c].to_numpy(), first) for c in ("docs", "n")]
    return pa.table([*keys.columns, *sums], schema=_POSTING)


def postings(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, source, docs, n): in how many documents of a group a term occurs, and how often."""
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(n) for c, n in ((lang, "l"), (source, "s"), (text, "t"))])
    schema = "lang string, term string, source string, docs bigint, n bigint"
    runs = read.mapInArrow(_index, schema)
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(_merge, schema)


# Divergence --------------------------------------------------------------------------------------


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (n + 1) / total)`` in long division, exact below 9.2e15 occurrences."""
    out, rest = np.zeros(len(n), dtype=np.int64), n + 1
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the groups they occur in to summed corrections (a, b, value) of pairs that share terms."""
    for batch in batches:
        lists = batch.column(0)
        gid, total, n = (a.to_numpy(zero_copy_only=False) for a in lists.flatten().flatten())
        begin = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = begin - begin[0]
        count = np.diff(begin)
        p, none = share(n, total), share(np.zeros_like(n), total)
        ids, code = np.unique(gid, return_inverse=True)
        few = len(ids) ** 2 <= 4 * SLICE
        dense = np.zeros(len(ids) ** 2 if few else 0, dtype=np.int64)
        # Every posting meets all postings of its term, in slices of bounded size.
        size, from_row = np.repeat(count, count), np.repeat(begin[:-1], count)
        ends = np.cumsum(size)
        low = 0
        while low < len(size):
            high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, side="right"))
            high = max(high, low + 1)
            which, right = texts.expand(from_row[low:high], from_row[low:high] + size[low:high])
            left = which + low
            apart = left != right
            left, right = left[apart], right[apart]
            p_a, p_b, none_a, none_b = p[left], p[right], none[left], none[right]
            value = gap(p_a, p_b) - gap(p_a, none_b) - gap(none_a, p_b) + gap(none_a, none_b)
            key = code[left] * len(ids) + code[right]
            if few:
                np.add.at(dense, key, value)
            else:
                pair, inverse = np.unique(key, return_inverse=True)
                part = np.zeros(len(pair), dtype=np.int64)
                np.add.at(part, inverse, value)
                yield _made(ids, pair, part)
            low = high
        if few:
            pair = np.flatnonzero(dense)
            yield _made(ids, pair, dense[pair])


def _made(ids: np.ndarray, pair: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(ids[pair // max(len(ids), 1)]), pa.array(ids[pair % max(len(ids), 1)]), pa.array(value)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "value"])


def _share(n: Column, total: Column) -> Column:
    scaled = (n.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(11,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of all pairs of sources, and each source's own terms.

    Part ``pair`` has every other source of the language by divergence; part ``term`` the terms that
    a source uses most in excess of its language, to rank ``TOP_TERMS``.
    """
    empty = F.lit("")
    names = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    found = materialise(postings(docs, lang, source, text))
    totals = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"))
    totals = materialise(totals.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "all"))
    kept = materialise(found.join(totals, ["lang", "term"]).select("lang", "term", "source", "n", "all"))
    # One row per source of a language; the result has one for every pair of them.
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_size"))
    groups = names.distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = groups.select(
        "lang",
        "source",
        F.monotonically_increasing_id().alias("gid"),
        (F.coalesce("size", zero) + F.coalesce("v", zero)).alias("total"),
        (F.coalesce("lang_size", zero) + F.coalesce("v", zero)).alias("lang_total"),
        F.coalesce("v", zero).alias("v"),
    )
    groups = materialise(groups)
    marks = broadcast_if_small(groups)
    return _pairs(kept, groups, marks).unionByName(_own_terms(kept, marks))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    if part == "term":
        rows = rows.filter(F.col("rank") <= TOP_TERMS)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _own_terms(kept: DataFrame, marks: DataFrame) -> DataFrame:
    rows = kept.join(marks, ["lang", "source"])
    rows = rows.withColumns({"p": _share(F.col("n"), F.col("total")), "q": _share(F.col("all"), F.col("lang_total"))})
    rows = rows.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows, "term")


def _pairs(kept: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    rows = kept.join(marks, ["lang", "source"]).select("lang", "term", "gid", F.col("total").alias("size"), "n")
    by_term = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "size", "n")).alias("groups"))
    shared = by_term.filter(F.size("groups") > 1).select("groups").mapInArrow(_pair_rows, "a bigint, b bigint, value bigint")
    wide = "decimal(38,0)"
    shared = shared.groupBy("a", "b").agg(F.sum(F.col("value").cast(wide)).alias("both"))
    # What a source's terms change against a source that has none of them, and the other way round.
    spread = rows.groupBy("lang", "gid", "size", "n").agg(F.count(F.lit(1)).alias("terms"))
    ends = groups.filter("v > 0").select("lang", F.col("gid").alias("b"), F.col("total").alias("b_total"))
    zero = F.lit(0)
    each = spread.join(broadcast_if_small(ends), "lang").filter("gid <> b")
    own, none = _share(F.col("n"), F.col("size")), _share(zero, F.col("size"))
    other = _share(zero, F.col("b_total"))
    times = F.col("terms").cast(wide)
    each = each.select("gid", "b", ((_gap(own, other) - _gap(none, other)) * times).alias("as_p"), ((_gap(other, own) - _gap(other, none)) * times).alias("as_q"))
    one = each.groupBy(F.col("gid").alias("a"), "b").agg(F.sum("as_p").alias("left"))
    two = each.groupBy(F.col("b").alias("a"), F.col("gid").alias("b")).agg(F.sum("as_q").alias("right"))
    left = groups.select("lang", "source", F.col("gid").alias("a"), F.col("total").alias("a_total"), "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("total").alias("b_total"))
    # The result itself has a row for each of these pairs.
    every = left.join(right, "lang").filter("a <> b")
    every = every.join(one, ["a", "b"], "left").join(two, ["a", "b"], "left").join(shared, ["a", "b"], "left")
    base = F.when(F.col("v") > 0, _gap(_share(zero, F.col("a_total")), _share(zero, F.col("b_total"))).cast(wide) * F.col("v"))
    value = sum((F.coalesce(c, F.lit(0).cast(wide)) for c in (base, F.col("left"), F.col("right"), F.col("both"))), F.lit(0).cast(wide))
    return _ranked(every.select("lang", "source", "item", value.cast("bigint").alias("value")), "pair")
