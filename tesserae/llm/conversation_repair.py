"""Repair of damaged conversations by weighted interval parsing.

A conversation should read ``(system)? (user assistant)+`` by the initials of its roles, or be
empty. Rows may be kept, given another role, deleted, and empty rows inserted, each at a cost;
the cheapest edits win, ties by the least string of their initials (``D``, ``I``, ``K``, ``R``).

The repair grammar is in Chomsky normal form. Its nonterminals are pairs of states of the wanted
order (0 nothing yet, 1 after system, 2 after user, 3 after assistant): ``N[i, j]`` derives what
leads from state i to state j. A row derives ``N[i, j]`` by the edit that does so, and
``N[i, j] -> N[i, k] N[k, j]`` joins neighbouring spans. A cell holds the minimum (cost, audit) of
each nonterminal over a span and is closed under insertions. Cells are combined bottom-up
by span length, as in CYK. Since every way to bracket a span has the same derivations here, one
split of a span gives its minimum: the chart needs only spans of doubling length, not all of them,
and its size grows with the rows and not with their square. Equal costs never leave one audit a
prefix of the other (an audit longer by insertions costs more), so minima may be joined.

A conversation is cut into pieces of ``PIECE`` rows; tasks parse pieces of any conversation, one
pass joins the cells of a conversation's pieces, and every piece gets its part of the edits
back. Thus no task holds the texts of a whole conversation, however long it is.

Defined cases: rows order by turn (null first), then role, then text, so ties and repeated
rows have one order; null roles and texts are read as one space; an empty role has no initial, so
its row can't be kept as it is; a null conversation id is a
conversation of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ordering import number_rows
from tesserae.session import materialise

RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows parsed together; also the rows whose edits are handled as one string.
PIECE = 256

#: A character that is not blank; the last one of a whole text ends a sentence.
SOLID = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"

Cell = dict[tuple[int, int], tuple[int, str]]

#: State after each role initial; what is missing is not allowed.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: States that may end a conversation, and insertions between two states at least cost.
ENDS = (0, 3)


def _inserts() -> Cell:
    cell: Cell = {(i, i): (0, "") for i in range(4)}
    for start in range(4):
        state, audit = start, ""
        for _ in range(2):
            state = STEPS["u"].get(state) or STEPS["a"][state]
            audit += "I"
            cell.setdefault((start, state), (INSERT * len(audit), audit))
    return cell


def join(left: Cell, right: Cell) -> Cell:
    """The minimum of ``N[i, k] N[k, j]`` over all k."""
    out: Cell = {}
    for (i, k), (cost, audit) in left.items():
        for j in range(4):
            more = right.get((k, j))
            if more is not None:
                made = (cost + more[0], audit + more[1])
                if (i, j) not in out or made < out[i, j]:
                    out[i, j] = made
    return out


INSERTS = _inserts()


def row_cell(initial: str, must_go: bool, cut: bool) -> Cell:
    """What one row derives, closed under insertions after it."""
    cell: Cell = {(i, i): (DELETE, "D") for i in range(4)}
    if not must_go:
        more = CUT if cut else 0
        for role in "ua":
            for i, j in STEPS[role].items():
                cell[i, j] = min(cell.get((i, j), (1 << 60, "")), (RETAG + more, "R"))
        for i, j in STEPS.get(initial, {}).items():
            cell[i, j] = min(cell.get((i, j), (1 << 60, "")), (more, "K"))
    return join(cell, INSERTS)


def parse(cells: list[Cell]) -> Cell:
    """Cells of neighbouring spans combined bottom-up by span length into that of the whole."""
    while len(cells) > 1:
        paired = [join(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0] if cells else {(i, i): (0, "") for i in range(4)}


def cheapest(cell: Cell) -> tuple[int, str]:
    """The best complete derivation, with insertions before the first row."""
    whole = join(INSERTS, cell)
    return min(whole[0, j] for j in ENDS if (0, j) in whole)


# Rows ------------------------------------------------------------------------------------------


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, fault): rows in order from 1 with their first fault, or null."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = materialise(number_rows(rows, ["conv_id"], ["turn", "role", "text"], "pos"))
    same = F.md5(F.concat(F.col("role"), F.lit("\x00"), F.col("text"))).alias("same")
    # Rows without a character have their fault already: only others are compared.
    solid = F.regexp_like("text", F.lit(SOLID))
    seen = number_rows(rows.filter(solid).select("conv_id", "pos", same), ["conv_id", "same"], ["pos"], "copy")
    again = seen.filter("copy > 1").select(F.col("conv_id").alias("c"), F.col("pos").alias("p"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    fault = F.when(~solid, "blank").when(F.col("p").isNotNull(), "duplicate")
    fault = fault.when(~F.regexp_like("text", F.lit(WHOLE)), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "pos", fault.alias("fault"))


def _piece() -> Column:
    return F.floor((F.col("pos") - 1) / PIECE).cast("bigint").alias("piece")


_CELLS = "conv_id bigint, piece bigint, cells array<struct<i: int, j: int, cost: bigint, audit: string>>"
_EDITS = "conv_id bigint, piece bigint, edits string, before bigint, total bigint, cost bigint"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows of equal first ``keys`` columns in sorted batches: (key, rows)."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_CELL_TYPE = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_CELLS_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("cells", pa.list_(_CELL_TYPE))])
_EDITS_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("edits", pa.string()), ("before", pa.int64()), ("total", pa.int64()), ("cost", pa.int64())]
)


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, Cell] = {}

    def rows() -> Iterator[dict]:
        for (conv, piece), held in _runs(batches, 2):
            cells = []
            for _, initial, must_go, cut in held:
                kind = (initial if initial in STEPS else "", must_go, cut)
                if kind not in known:
                    known[kind] = row_cell(*kind)
                cells.append(known[kind])
            whole = [{"i": i, "j": j, "cost": c, "audit": a} for (i, j), (c, a) in parse(cells).items()]
            yield {"conv_id": conv, "piece": piece, "cells": whole}

    yield from _batched(rows(), _CELLS_SCHEMA, 512)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for (conv,), held in _runs(batches, 1):
            cells = [{(c["i"], c["j"]): (c["cost"], c["audit"]) for c in cell} for _, cell in held]
            cost, audit = cheapest(parse(cells))
            total = len(audit) - audit.count("D")
            at = before = 0
            for number, (piece, _) in enumerate(held):
                # A piece takes the edits of its rows, with the insertions before each.
                end = at
                if number == len(held) - 1:
                    end = len(audit)
                else:
                    left = PIECE
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                part = audit[at:end]
                yield {"conv_id": conv, "piece": piece, "edits": part, "before": before, "total": total, "cost": cost}
                at, before = end, before + len(part) - part.count("D")

    yield from _batched(rows(), _EDITS_SCHEMA, 512)


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, edits, before, total, cost) of ``ordered`` rows.

    ``edits`` are the edits of a piece of rows, ``before`` the rows that earlier pieces leave and
    ``total`` those of the whole conversation; ``cost`` is that of the whole conversation.
    """
    initial = F.substring("role", 1, 1).alias("initial")
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone")
    cut = F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut")
    light = rows.select(F.col("conv_id").cast("bigint"), _piece(), "pos", initial, gone, cut)
    # The number is given: parsing is work in Python, and rows this light would be merged into few tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = light.repartition(tasks, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos")
    cells = pieces.mapInArrow(_parse_pieces, _CELLS)
    # One row for so many rows of the conversation; audits take some bytes a row.
    return materialise(cells).repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_join_pieces, _EDITS)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, number, role, text, edit): the rows of repaired conversations in order of ``number``.

    ``pos`` is the row that was kept or given a role, null for inserted ones.
    """
    # The edit of each row with the insertions before it; the rest of a last piece follows its last row.
    tokens = F.regexp_extract_all("edits", F.lit("(I*[DKR])"))
    within = F.pmod(F.col("pos") - 1, F.lit(PIECE)).cast("int")
    found = found.withColumn("tokens", tokens)
    found = found.withColumn("rest", F.regexp_extract("edits", "[DKR](I+)$", 1))
    found = found.select(F.col("conv_id").alias("c"), F.col("piece").alias("q"), "tokens", "rest", "before", "total")
    rows = rows.withColumn("piece", _piece())
    both = rows.join(found, rows["conv_id"].eqNullSafe(found["c"]) & (rows["piece"] == found["q"]))
    earlier = F.array_join(F.slice("tokens", F.lit(1), within), "")
    both = both.withColumn("first", F.col("before") + F.length(earlier) - F.regexp_count(earlier, F.lit("D")))
    last = within + 1 == F.size("tokens")
    ops = F.concat(F.get("tokens", within), F.when(last, F.col("rest")).otherwise(F.lit("")))
    ops = F.filter(F.split(ops, ""), lambda e: ~e.isin("", "D"))
    both = both.withColumn("ops", ops)
    lines = both.select("conv_id", "pos", "role", "text", "first", "total", F.posexplode("ops").alias("nth", "edit"))
    number = F.col("first") + F.col("nth")
    # With an odd number of rows the first is the system's.
    even = F.pmod(number - F.pmod(F.col("total"), F.lit(2)), F.lit(2)) == 0
    wanted = F.when(even, "user").otherwise("assistant")
    own = F.col("edit") != "I"
    return lines.select(
        "conv_id",
        F.when(own, F.col("pos")).alias("pos"),
        number.alias("number"),
        F.when(F.col("edit") == "K", F.col("role")).otherwise(wanted).alias("role"),
        F.when(own, F.col("text")).otherwise(F.lit("")).alias("text"),
        "edit",
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def rows() -> Iterator[dict]:
        conv, state = None, None
        for batch in batches:
            for key, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if state is None or key != conv:
                    if state is not None:
                        yield {"conv_id": conv, "sha256": state.hexdigest()}
                    conv, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield {"conv_id": conv, "sha256": state.hexdigest()}

    yield from _batched(rows(), schema, 1024)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines of ``repaired`` rows; a conversation streams through one task."""
    lines = lines.select(F.col("conv_id").cast("bigint"), "number", "role", "text")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(_digest, "conv_id bigint, sha256 string")


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of faults and the edits of every conversation of ``ordered`` rows that has rows."""
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    faults = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
    )
    # Neighbours: a row is sent to its own place and to the next.
    initial = F.substring("role", 1, 1)
    sides = F.array(
        F.struct(F.col("pos").alias("at"), F.lit(None).cast("string").alias("left"), initial.alias("right")),
        F.struct((F.col("pos") + 1).alias("at"), initial.alias("left"), F.lit(None).cast("string").alias("right")),
    )
    pairs = rows.select("conv_id", F.inline(sides)).groupBy("conv_id", "at").agg(F.max("left").alias("l"), F.max("right").alias("r"))
    pairs = pairs.filter("l IS NOT NULL AND r IS NOT NULL")
    illegal = pairs.groupBy("conv_id").agg(F.count_if(~F.concat("l", "r").isin("su", "ua", "au")).alias("illegal"))
    parts = F.sort_array(F.collect_list(F.struct("piece", "edits")))
    whole = found.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "c")
        return left.join(right, left["conv_id"].eqNullSafe(right["c"]), "left").drop("c")

    out = beside(beside(faults, illegal), whole)
    return beside(out, digests(repaired(rows, found))).withColumns(
        {
            "illegal": F.coalesce("illegal", F.lit(0)).cast("bigint"),
            "repaired_sha256": F.coalesce("sha256", F.sha2(F.lit(""), 256)),
        }
    ).drop("sha256")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, pos, number, role, text, edit) of conversations (conv_id, turn, role, text)."""
    told = materialise(ordered(rows))
    return repaired(told, materialise(edits(told)))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults by a hash of conversation and turn, for trying repairs.

    Of 20 hash values, 0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats
    the row, 4 gives it the role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")), "times": times})
    return rows.select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")
