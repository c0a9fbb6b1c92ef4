"""Conversation repair against a search over all edits, a full chart, and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tesserae.llm import conversation_repair as repair

TURNS = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest (cost, audit, lines) by Dijkstra-like search over (rows used, lines' initials)."""
    marks = faults(rows)
    best = {(0, ""): (0, "", ())}
    limit = 2 * len(rows) + 3
    for at in range(len(rows) + 1):
        here = {k: v for k, v in best.items() if k[0] == at}
        # Insertions, up to two beyond what rows can need.
        for _ in range(3):
            for (n, out), (cost, audit, lines) in list(here.items()):
                if len(out) < limit and audit[-3:] != "III":
                    for role in ("user", "assistant"):
                        key, new = (n, out + role[0]), (cost + 3, audit + "I", (*lines, (role, "")))
                        if re.fullmatch(r"s?(ua)*u?", key[1]) and (key not in here or new[:2] < here[key][:2]):
                            here[key] = new
        best.update(here)
        if at == len(rows):
            break
        (role, text), mark = rows[at], marks[at]
        for (n, out), (cost, audit, lines) in here.items():
            ways = [(4, "D", "", ())]
            if mark in (None, "truncated"):
                more = 3 if mark else 0
                if role:
                    ways.append((more, "K", role[:1], ((role, text),)))
                ways += [(3 + more, "R", r[0], ((r, text),)) for r in ("user", "assistant")]
            for c, e, initial, line in ways:
                if e != "D" and not re.fullmatch(r"s?(ua)*u?", out + initial):
                    continue
                key, new = (at + 1, out + initial), (cost + c, audit + e, (*lines, *line))
                if key not in best or new[:2] < best[key][:2]:
                    best[key] = new
    done = [v for (n, out), v in best.items() if n == len(rows) and GOOD.fullmatch(out)]
    return min(done, key=lambda v: v[:2])


def conversation(r, size):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "umpire"]
    said = ["Yes.", "no", " ", "", "What?  ", "a.\n", "Fine!", "\x1c", "x. y"]
    return [(r.choice(roles), r.choice(said)) for _ in range(size)]


def test_cheapest_edits_equal_a_search_over_all():
    r = random.Random(5)
    for size in [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7] * 6:
        rows = conversation(r, size)
        marks = faults(rows)
        cells = [repair.row_cell(role[:1], m in ("blank", "duplicate"), m == "truncated") for (role, _), m in zip(rows, marks)]
        assert repair.cheapest(repair.parse(cells)) == brute(rows)[:2], rows


def test_one_split_a_span_equals_the_full_chart():
    r = random.Random(6)
    kinds = [repair.row_cell(i, g, c) for i, g, c in itertools.product(["s", "u", "a", ""], [False, True], [False, True])]
    for size in (1, 2, 5, 9, 14):
        cells = [r.choice(kinds) for _ in range(size)]
        chart = {(i, i + 1): c for i, c in enumerate(cells)}
        for length in range(2, size + 1):
            for i in range(size - length + 1):
                found = {}
                for k in range(i + 1, i + length):
                    for key, value in repair.join(chart[i, k], chart[k, i + length]).items():
                        found[key] = min(found.get(key, value), value)
                chart[i, i + length] = found
        assert repair.parse(cells) == chart[0, size]


@pytest.mark.parametrize("piece", [2, 3, 256])
def test_tables_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    r = random.Random(piece)
    made = {None if c == 0 else c: conversation(r, r.randint(1, 9)) for c in range(40)}
    rows = [(c, t, role, text) for c, turns in made.items() for t, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    told = repair.ordered(spark.createDataFrame(rows, TURNS))
    found = repair.edits(told)
    got = {x.conv_id: x for x in repair.summary(told, found).collect()}
    assert set(got) == set(made)
    for c, turns in made.items():
        cost, audit, lines = brute(turns)
        body = "\n".join(f"{role}:{text}" for role, text in lines)
        marks, x = faults(turns), got[c]
        assert (x.cost, x.audit) == (cost, audit), turns
        assert x.repaired_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert [x.blank, x.duplicate, x.truncated] == [marks.count(k) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        assert x.illegal == sum(p not in ("su", "ua", "au") for p in pairs) and x.gaps == 0
    out = {}
    for x in repair.repaired(told, found).orderBy("number").collect():
        out.setdefault(x.conv_id, []).append((x.role, x.text))
    assert {c: tuple(v) for c, v in out.items()} == {c: w for c, t in made.items() if (w := brute(t)[2])}


def test_long_conversation_and_odd_rows(spark):
    r = random.Random(9)
    long = [(1, None if i == 0 else i * 2, role, text + str(i) + ".") for i, (role, text) in enumerate(conversation(r, 3000))]
    odd = [(2, 5, None, None), (2, 5, None, None), (2, None, "user", "x" * 500_000 + "."), (3, None, "user", "Hi.")]
    rows = spark.createDataFrame(long + odd, TURNS).selectExpr("*", "1 AS pos", "'f' AS fault", "2 AS piece")
    told = repair.ordered(rows)
    got = {x.conv_id: x for x in repair.summary(told, repair.edits(told)).collect()}
    cells = [repair.row_cell((role or " ")[:1], False, False) for _, _, role, _ in long]
    assert (got[1].cost, got[1].audit) == repair.cheapest(repair.parse(cells))
    assert got[1].gaps == 2999 * 2 - 1 - 2999
    assert (got[2].blank, got[2].duplicate, got[2].gaps, got[2].audit) == (2, 0, 0, "KDDI")
    assert got[3].audit == "KI" and got[3].gaps == 0
    body = [(x.role, x.text) for x in repair.repair(rows).filter("conv_id = 2").orderBy("number").collect()]
    assert body == [("user", "x" * 500_000 + "."), ("assistant", "")]
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(empty).count() == 0
    assert repair.summary(repair.ordered(empty), repair.edits(repair.ordered(empty))).count() == 0


def test_damage(spark):
    rows = [(c if c else None, t if t else None, None if t == 3 else "assistant", f"a{t}. b!") for c in range(20) for t in range(20)]
    got = sorted(map(str, repair.damage(spark.createDataFrame(rows, TURNS)).collect()))
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role or " "
        want += [f"Row(conv_id={c}, turn={t}, role={role!r}, text={text!r})"] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)
