"""Source divergence against exact arithmetic in plain Python."""

import collections
import random
import re

import pyarrow as pa
import pytest

from tesserae.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top):
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        v, others = len(kept), sorted(s for l, s in groups if l == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept) + v
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in others}
        whole = shares(sum((count[lang, s] for s in others), collections.Counter()))
        mine = p[source]
        pairs = [(sum((mine[t] - p[s][t]) ** 2 // p[s][t] for t in kept), s) for s in others if s != source]
        own = [((mine[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, source][t] and mine[t] > whole[t]]
        for part, found, limit in (("pair", pairs, len(pairs)), ("term", own, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def sample(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abCDé ñ漢") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["it's", "A-b", "x1y", "\u212a"]
    rows = []
    for _ in range(n):
        bias = words[r.randrange(40) :]
        text = " ".join(r.choice(bias) for _ in range(r.randint(0, 40)))
        rows.append((text, r.choice(["en", "fr", None]), r.choice(["s0", "s1", "S1", "", None, "é", "z"])))
    rows += [(None, "en", "no words"), ("", "xx", "a"), ("alone", "xx", "b"), ("12 34", "xx", None), (None, None, None)]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, s, "clash") for i, (t, lang, s) in enumerate(rows)], DOCS)


def test_equal_to_exact_arithmetic(spark, monkeypatch):
    rows = sample(3, 300)
    monkeypatch.setattr(divergence, "TOP_TERMS", 12)
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows).repartition(3)).collect())
    assert got == brute(rows, 12)


def _tables(rows, size):
    for low in range(0, len(rows), size):
        part = rows[low : low + size]
        cols = [[r[1] or "" for r in part], [r[2] or "" for r in part], [r[0] or "" for r in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["l", "s", "t"])


def test_runs_and_merge_in_small_blocks(monkeypatch):
    """Spilled runs, long texts in pieces, and keys that go on in the next batch."""
    for name, value in (("BLOCK_BYTES", 3000), ("PIECE_BYTES", 32)):
        monkeypatch.setattr(divergence, name, value)
    rows = sample(4, 200) + [("ab CD é " * 50 + "x" * 300 + " ab", "en", "s0")]
    runs, now = [], []
    for batch in divergence._index(_tables(rows, 17)):
        now = batch.to_pylist()
        keys = [(r["lang"], r["term"].encode(), r["source"]) for r in now]
        assert keys == sorted(keys)
        runs.append(now)
    assert len(runs) > 3
    want_n, want_docs = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for t, n in collections.Counter(terms).items():
            want_n[lang or "", t, source or ""] += n
            want_docs[lang or "", t, source or ""] += 1
    every = sorted((r for run in runs for r in run), key=lambda r: (r["lang"], r["term"].encode(), r["source"]))
    batches = (pa.Table.from_pylist(every[i : i + 7], divergence._POSTING).to_batches()[0] for i in range(0, len(every), 7))
    merged = [r for b in divergence._merge(batches) for r in b.to_pylist()]
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in merged} == want_n
    assert {(r["lang"], r["term"], r["source"]): r["docs"] for r in merged} == want_docs
    assert len(merged) == len(want_n)


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_corrections_in_slices(monkeypatch, size):
    monkeypatch.setattr(divergence, "SLICE", size)
    r = random.Random(size)
    terms = [[{"gid": g, "size": 1000 + g, "n": r.randint(1, 50)} for g in r.sample(range(9), r.randint(1, 6))] for _ in range(40)]
    kind = pa.list_(pa.struct([("gid", pa.int64()), ("size", pa.int64()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(terms, kind)], names=["groups"]).slice(5)
    got = collections.Counter()
    for out in divergence._pair_rows(iter([batch])):
        for x in out.to_pylist():
            got[x["a"], x["b"]] += x["value"]
    want = collections.Counter()
    share = lambda x, n: 1 + 10**9 * (n + 1) // x["size"]
    gap = lambda p, q: (p - q) ** 2 // q
    for groups in terms[5:]:
        for a in groups:
            for b in groups:
                if a is not b:
                    p, q, p0, q0 = share(a, a["n"]), share(b, b["n"]), share(a, 0), share(b, 0)
                    want[a["gid"], b["gid"]] += gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_table_and_long_text(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    rows = [("Word " * 700_000 + "y" * 2_500_000, "en", "a"), ("word y", "en", "b"), ("word", "en", "b"), ("1 2 3", "en", "c")]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    assert got == brute(rows, 200)
