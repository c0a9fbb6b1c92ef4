"""Near-duplicate lines by a segment-partition edit join, in SQL functions only.

Two lines within ``edits`` edits: cut the one no longer than the other into ``edits + 1``
segments, and by pigeonhole one segment stands unharmed in the other line. The segments of all
lines are indexed by (length, number, content). Every line probes the index for each length
within reach with those of its substrings that can align with a segment; which shifts can is
bounded from the left and from the right end of the line. Pairs that meet are verified by a
banded bit-parallel edit distance: the states of a diagonal band are bits of one number, moved
on one character at a time. Lines of at most ``edits`` characters have no such segments; they
are indexed by all that is left of them after deletions, which lines of at most twice that
length probe with up to ``edits`` deletions of their own, so lines of every length are joined.

Equal lines are one node, so a line in a third of all documents costs no more than another.
A segment that very many different lines share is taken out of the join: its lines are cut
into blocks, and a probe meets a block as one array, which is filtered in place. So the join
makes at most ``BLOCK_LINES`` rows per probe, and a hot segment is spread over tasks.

Classes are given per different line (``line_classes``), per place of a line (``line_places``),
and applied to the texts (``without_repeats``). Places find their line by 128 bits of hash, so no
text is shuffled for them and no list of places is gathered.

Defined cases: null texts have no lines; lines without a word are ignored; the bound of
``edits`` is the same for lines of any length, so different lines of at most ``edits``
characters are all near each other; repeated rows and null ids count as further copies, the first place of a line being that of the least id (null
last) and least line number; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.components import roots
from tesserae.llm.names import fresh
from tesserae.session import BROADCAST_ROWS, materialise, shared_dir

#: Largest edit distance between near-duplicate lines.
EDITS = 2
#: Index entries of one key from which on they are matched in blocks of this many.
BLOCK_LINES = 16
#: Letters that are counted to rule out pairs inside blocks.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Pieces of a line that are looked for in the other before a pair is verified.
PIECES = 16


def segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """(0-based start, length) of a segment; the last ones take the odd characters."""
    base = F.floor(length / (edits + 1)).cast("int")
    long_from = (edits + 1) - length % (edits + 1)
    start = base * number + F.greatest(F.lit(number) - long_from, F.lit(0))
    return start, base + F.when(F.lit(number) >= long_from, 1).otherwise(0)


def shifts(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, shift) of every substring to probe."""
    out = []
    for less in range(edits + 1):
        for number in range(edits + 1):
            low = max(-number, less - (edits - number))
            high = min(number, less + (edits - number))
            out += [(less, number, s) for s in range(low, high + 1)]
    return out


def deletions(line: Column, edits: int) -> Column:
    """All strings that are left of a line after at most ``edits`` deletions."""
    out = F.array(line)
    for _ in range(edits):
        out = F.array_distinct(F.flatten(F.transform(out, lambda v: F.concat(F.array(v), _one_deletion(v)))))
    return out


def _one_deletion(v: Column) -> Column:
    fewer = F.transform(
        F.sequence(F.lit(1), F.length(v)),
        lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))),
    )
    return F.when(F.length(v) > 0, fewer).otherwise(F.array().cast("array<string>"))


def deletion_keys(line: Column, edits: int) -> Column:
    return F.transform(deletions(line, edits), lambda v: F.xxhash64(F.lit(0), F.lit(-1), v))


def index_keys(line: Column, length: Column, edits: int) -> Column:
    out = []
    for number in range(edits + 1):
        start, size = segment(length, number, edits)
        out.append(F.xxhash64(length, F.lit(number), F.substring(line, start + 1, size)))
    return F.array(*out)


def probe_keys(line: Column, length: Column, edits: int) -> Column:
    out = []
    for less, number, shift in shifts(edits):
        # The bounds on the shift keep every substring inside the line.
        start, size = segment(length - less, number, edits)
        out.append(F.xxhash64(length - less, F.lit(number), F.substring(line, start + shift + 1, size)))
    return F.array(*out)


def letters(line: Column) -> Column:
    """How often each of the letters a to z occurs."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def letters_near(a: Column, b: Column, edits: int) -> Column:
    """A necessary condition on letter counts: an edit takes one letter and adds one at most."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x) <= 2 * edits


def may_be_within(a: Column, b: Column, edits: int) -> Column:
    """A necessary condition: of disjoint pieces of ``a`` an edit harms one at most, and an unharmed
    piece stands in ``b`` no further than ``edits`` from its place."""
    size = F.floor(F.length(a) / PIECES).cast("int")
    harmed = F.lit(0)
    for number in range(PIECES):
        start = size * number
        before = F.least(start, F.lit(edits))
        around = F.substring(b, start - before + 1, size + before + edits)
        harmed = harmed + F.when(F.contains(around, F.substring(a, start + 1, size)), 0).otherwise(1)
    return harmed <= edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``, by a banded bit-parallel computation.

    The band holds the rows within ``edits`` of the diagonal. Column by column, two numbers hold
    where the distance grows (``vp``) and falls (``vn``) from row to row, one bit per row; sums
    and shifts of these bits give the next column. ``score`` follows the lowest row of the band
    and, once that has reached the end of ``a``, its last row. ``a`` must have ``edits``
    characters at least.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    pair = F.struct(chars_a.alias("a"), chars_b.alias("b"), F.length(a).alias("m"), F.length(b).alias("n"))

    def distance(p: Column) -> Column:
        start = F.struct(
            F.lit(full ^ ((1 << (width - edits - 1)) - 1)).cast("bigint").alias("vp"),
            F.lit(0).cast("bigint").alias("vn"),
            F.lit(edits).alias("score"),
            F.lit(top >> 1).cast("bigint").alias("last"),
        )

        def step(state: Column, j: Column) -> Column:
            match = F.lit(0).cast("bigint")
            here = F.get(p["b"], j)
            for k in range(width):
                row = j + (edits - (width - 1 - k))
                same = (row >= 0) & (F.get(p["a"], row) == here)
                match = match + F.when(same, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            return column(state, match, j)

        def column(state: Column, match: Column, j: Column) -> Column:
            # One value is bound to a name by a fold over a single element.
            first = F.aggregate(
                F.array(match),
                F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), F.lit(0).cast("bigint").alias("d")),
                lambda s, x: F.struct(
                    s["vp"].alias("vp"),
                    s["vn"].alias("vn"),
                    (
                        ((x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))
                    ).alias("d"),
                ),
            )
            return F.get(F.transform(F.array(first), lambda f: _next(state, f, p, j, edits, full, top)), F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), p["n"] - 1), start, step, lambda s: s["score"])

    near = F.get(F.transform(F.array(pair), distance), F.lit(0)) <= edits
    return (F.abs(F.length(a) - F.length(b)) <= edits) & near


def near(a: Column, b: Column, edits: int) -> Column:
    """``within`` for an ``a`` of any length that is no longer than ``b``."""
    return F.when(F.length(a) <= edits, F.levenshtein(a, b) <= edits).otherwise(within(a, b, edits))


def _next(state: Column, f: Column, p: Column, j: Column, edits: int, full: int, top: int) -> Column:
    """The state after a column with diagonal bits ``f.d``."""
    up = f["vn"].bitwiseOR(F.bitwise_not(f["d"].bitwiseOR(f["vp"]))).bitwiseAND(F.lit(full))
    down = f["d"].bitwiseAND(f["vp"])
    slid = F.shiftright(f["d"], 1)
    inside = j < p["m"] - edits
    bit = lambda value, mask: F.when(value.bitwiseAND(mask) != 0, 1).otherwise(0)
    along = state["score"] + 1 - bit(f["d"], F.lit(top).cast("bigint"))
    across = state["score"] + bit(up, state["last"]) - bit(down, state["last"])
    return F.struct(
        down.bitwiseOR(F.bitwise_not(slid.bitwiseOR(up))).bitwiseAND(F.lit(full)).alias("vp"),
        slid.bitwiseAND(up).alias("vn"),
        F.when(inside, along).otherwise(across).cast("int").alias("score"),
        F.when(inside, state["last"]).otherwise(F.shiftright(state["last"], 1)).alias("last"),
    )


def _lines(docs: DataFrame, text: str, *carried: Column) -> DataFrame:
    """(carried columns, no, line): every line with a word."""
    rows = docs.select(*carried, F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("no", "line"))
    return rows.filter(F.col("line").rlike(texts.WORD))


def _hashes() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def distinct_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, length, copies, doc_id, line_no), stored: every different line, where it stands first, how often."""
    rows = _lines(docs, text, F.col(f"`{key}`").alias("k"))
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "no"))
    found = rows.groupBy("line").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))
    found = found.select(
        F.monotonically_increasing_id().alias("id"),
        "line",
        F.length("line").alias("length"),
        "copies",
        F.col("first.k").alias("doc_id"),
        F.col("first.no").alias("line_no"),
    )
    spark = docs.sparkSession
    path = os.path.join(shared_dir(spark), f"lines-{uuid.uuid4().hex}")
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def links(lines: DataFrame, edits: int = EDITS, min_chars: int = 1, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(a, b) ids of lines within ``edits`` edits of each other, each pair once.

    Lines below ``min_chars`` are left out; by default none are.
    """
    usable = lines.filter(F.col("length") >= min_chars).select("id", "line", "length")
    line, length = F.col("line"), F.col("length")
    cut = usable.filter(length > edits)
    index = cut.select(F.explode(index_keys(line, length, edits)).alias("key"), "id", "length")
    probe = cut.select(F.explode(probe_keys(line, length, edits)).alias("key"), "id", "length")
    # Deletions are taken apart from the segments, whose keys are made by compiled code alone.
    short = usable.filter(length <= 2 * edits).select(F.explode(deletion_keys(line, edits)).alias("key"), "id", "length")
    short = materialise(short)
    index, probe = index.unionByName(short.filter(length <= edits)), probe.unionByName(short)
    hot = materialise(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_lines))

    # One row in place of all the entries of a hot key marks the probes that must visit its blocks.
    marks = hot.select("key", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("int").alias("length"), "n")
    entries = index.join(hot, "key", "left_anti").withColumn("n", F.lit(None).cast("bigint")).unionByName(marks)
    same = F.col("i.length") == F.col("p.length")
    once = F.col("i.id").isNull() | (F.col("i.length") < F.col("p.length")) | (same & (F.col("i.id") < F.col("p.id")))
    met = entries.alias("i").join(probe.alias("p"), "key").filter(once)
    met = materialise(met.select("key", "n", F.col("i.id").alias("a"), F.col("p.id").alias("b")))
    pairs = met.filter("a IS NOT NULL").select("a", "b").distinct()
    asked = met.filter("a IS NULL").select("key", "n", F.col("b").alias("id"))
    held = materialise(index.join(hot, "key").select("key", "n", "id"))

    # Only lines in some pair or block are fetched, once.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(asked.select("id")).unionByName(held.select("id"))
    wanted = materialise(wanted.distinct())
    bodies = materialise(usable.join(_sent(wanted), "id", "left_semi"))
    one, other = (bodies.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}")) for c in ("a", "b"))
    pairs = pairs.join(one, "a").join(other, "b")
    pairs = pairs.filter(may_be_within(F.col("line_a"), F.col("line_b"), edits))
    found = pairs.filter(near(F.col("line_a"), F.col("line_b"), edits)).select("a", "b")

    blocks = F.ceil(F.col("n") / block_lines).cast("int")
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).join(bodies, "id")
    held = held.groupBy("key", "block").agg(
        F.collect_list(F.struct("id", "line", "length", letters(line).alias("letters"))).alias("lines")
    )
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    asked = asked.join(bodies, "id").withColumn("letters", letters(line))
    close = F.filter(
        "lines",
        lambda x: (
            (F.abs(x["length"] - F.col("length")) <= edits)
            & ((x["length"] < F.col("length")) | ((x["length"] == F.col("length")) & (x["id"] < F.col("id"))))
            & letters_near(x["letters"], F.col("letters"), edits)
            & may_be_within(x["line"], F.col("line"), edits)
            & near(x["line"], F.col("line"), edits)
        ),
    )
    more = asked.join(held, ["key", "block"]).select(F.explode(F.transform(close, lambda x: x["id"])).alias("a"), F.col("id").alias("b"))
    return materialise(found.unionByName(more).distinct())


def _sent(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked to be sent to the tasks if its rows are few; else both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _classed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` with ``links`` to other lines, ``class``, and the first place of the class (``first``)."""
    pairs = links(lines, edits)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    found = roots(pairs)
    # Only lines with links need a look at their class.
    near = lines.join(found, lines["id"] == found["node"]).select("root", "doc_id", "line_no")
    firsts = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")).alias("first"))
    table = found.join(firsts, "root").join(degree, found["node"] == degree["id"]).select("node", "root", "links", "first")
    out = lines.join(table, lines["id"] == table["node"], "left")
    linked = F.col("node").isNotNull()
    return out.select(
        *lines.columns,
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        F.coalesce("root", "id").alias("class"),
        F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_doc_id"),
        F.when(linked, F.col("first.line_no")).otherwise(F.col("line_no")).alias("class_line_no"),
    )


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per different line: where it stands first, ``copies``, ``links`` to other lines, and the
    first place of its class of near-duplicates (``class_doc_id``, ``class_line_no``)."""
    out = _classed(distinct_lines(docs, key, text), edits)
    return out.select("doc_id", "line_no", "length", "copies", "links", "class_doc_id", "class_line_no")


def line_places(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per line of every document: its place, ``copies`` and ``links`` of the line, where the line
    stands first (``first_doc_id``, ``first_line_no``), and the first place of its class of near-duplicates
    (``class_doc_id``, ``class_line_no``)."""
    lines = _classed(distinct_lines(docs, key, text), edits)
    lines = lines.withColumnsRenamed({"doc_id": "first_doc_id", "line_no": "first_line_no"})
    named = ["copies", "links", "first_doc_id", "first_line_no", "class_doc_id", "class_line_no"]
    lines = lines.select(*_hashes(), "length", *named)
    places = _lines(docs, text, F.col(f"`{key}`").alias("doc_id")).select("doc_id", F.col("no").alias("line_no"), *_hashes())
    return places.join(lines, ["h1", "h2"]).select("doc_id", "line_no", "length", *named)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` with one line of each class left in their texts, the one at the first place of the class.

    Lines without a word stay, and so do all rows; of rows that repeat a key one keeps the line.
    """
    row, keep = fresh(docs, "row"), fresh(docs, "keep")
    docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    lines = _classed(distinct_lines(docs, key, text), edits).select(*_hashes(), "class")
    places = _lines(docs, text, F.col(f"`{key}`").alias("k"), F.col(f"`{row}`").alias("row")).select("k", "row", "no", *_hashes())
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "no", "row")).alias("first")
    kept = places.join(lines, ["h1", "h2"]).groupBy("class").agg(first).select("first.row", "first.no")
    kept = kept.groupBy(F.col("row").alias(row)).agg(F.collect_list("no").alias(keep))

    def rebuilt(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(parts) - 1)
        plain = F.filter(numbers, lambda i: ~F.get(parts, i).rlike(texts.WORD))
        held = F.array_sort(F.array_union(plain, F.coalesce(F.col(keep), F.array().cast("array<int>"))))
        return F.array_join(F.transform(held, lambda i: F.get(parts, i)), "\n")

    body = F.col(f"`{text}`")
    # The lines are bound to a name, so that the text is split once.
    new = F.get(F.transform(F.array(F.split(body, "\n", -1)), rebuilt), F.lit(0))
    return docs.join(kept, row, "left").withColumn(text, F.when(body.isNotNull(), new)).drop(row, keep)
