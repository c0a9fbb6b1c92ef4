"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import (
    chat_format,
    components,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    sharding,
    texts,
    warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def prose(seed, n):
    r = random.Random(seed)
    made = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(made))


def edited(text, places):
    w = text.split(" ")
    for p in places:
        w[p] += "xq"
    return " ".join(w)


AWKWARD = [None, "", "   \n\t ", "one", "one two", "é ü \x1c x", "a\x0bb\x0cc\rd", "# # #", "\n\n\n"]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward_rows():
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", 1) for i, t in enumerate(AWKWARD)]
    return rows + rows[:3] + [(None, "null id here", "en", "s", None), (None, None, None, None, None)]


# texts ------------------------------------------------------------------------------------


def test_words_lines_and_windows_of_bytes():
    sample = AWKWARD + [prose(1, 50), "De De De De", "ß ß\nß ß\n\nß ß", "x" * 300]
    for budget in (1, 20, 1 << 20):
        got_words, got_lines = [[] for _ in sample], [[] for _ in sample]
        for part in texts.chunks(pa.array(sample, pa.string()), budget):
            w, line = texts.words(part), texts.lines(part)
            for spans, out in ((w, got_words), (line, got_lines)):
                for s, e, r in zip(spans.start, spans.end, spans.row):
                    out[part.first + r].append(bytes(part.data[s:e]).decode())
        assert got_words == [words(t) for t in sample]
        assert got_lines == [(t or "").split("\n") for t in sample]


def test_hashes_depend_on_bytes_alone():
    one = next(texts.chunks(pa.array(["ab cd ab", "cd"])))
    h = texts.hashes(one, texts.words(one))
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


# quality rules ------------------------------------------------------------------------------


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    often = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = awkward_rows() + [(100, "De De De De x", "en", "s", 1), (101, "a b c\na b c\nd | e", "en", "s", 1)]
    docs = documents(spark, rows)
    got = quality_rules.measure(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    left = sorted(([r.doc_id, *[r[n] for n in names]] for r in got), key=str)
    assert left == sorted(([r[0], *brute_counts(r[1])] for r in rows), key=str)


def test_estimate_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20000) < 0.85
    hit, alarm = np.array([0.6, 0.5, 0.7, 0.4]), np.array([0.02, 0.01, 0.03, 0.02])
    bad_vote = np.where(good[:, None], r.random((20000, 4)) < alarm, r.random((20000, 4)) < hit)
    votes = np.where(r.random((20000, 4)) < 0.1, 0, np.where(bad_vote, -1, 1))
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(patterns, count.astype(float))
    assert abs(model.good - 0.85) < 0.05
    assert np.abs(model.hit - hit).max() < 0.2 and np.abs(model.false_alarm - alarm).max() < 0.03
    again = quality_rules.estimate(patterns, count * 1000.0)
    assert abs(again.good - model.good) < 1e-3, "the estimate is the same at every size"


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [(i, prose(i, 80), "en", "s", 1) for i in range(60)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(i, 80).split()), "en", "s", 1) for i in range(6)]
    junk += [(2000 + i, prose(i, 80).upper().replace(" ", "!! "), "en", "s", 1) for i in range(6)]
    docs = documents(spark, clean + junk + awkward_rows())
    kept = {r.doc_id for r in quality_rules.kept_rows(docs).collect()}
    assert kept == {r[0] for r in clean}
    scored = quality_rules.score(quality_rules.measure(docs)).filter("kept").collect()
    assert {r.doc_id for r in scored} == kept
    # Columns may clash with the counts; all come back.
    clash = docs.withColumns({"n_words": F.lit("x"), "_counts": F.lit(1)})
    assert quality_rules.kept_rows(clash).columns == clash.columns
    assert quality_rules.kept_rows(docs.limit(0)).count() == 0


# sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_in_steps_of_one(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    index = sharding.hilbert_index(list(cells), bits)
    assert sorted(index) == list(range(1 << (dims * bits)))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def test_shards_are_even_and_gapless(spark):
    rows = [(i % 7 if i % 5 else None, "x" * (i % 50), ["en", None, "de"][i % 3], "hot" if i % 3 else f"s{i}", i) for i in range(503)]
    docs = documents(spark, rows).withColumns({"shard": F.lit("old"), "Slot": F.lit(1), "_curve": F.lit(2)})
    out = sharding.assign(docs, ["source", "lang", "n_chars"], ["doc_id"], 40)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "Slot")] + ["shard", "slot"]
    got = out.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 503 and sorted(by) == list(range(40))
    assert {len(v) for v in by.values()} <= {12, 13}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(str(r.n_chars) for r in got) == sorted(str(i) for i in range(503))
    few = sharding.assign(docs.limit(3), ["source"], ["doc_id"], 40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert sharding.assign(docs.limit(0), ["source"], ["doc_id"], 40).count() == 0


# quality classifier ---------------------------------------------------------------------------


def test_votes_equal_plain_nearest_neighbours():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(200, quality_classifier.TERMS))) * (r.random((200, quality_classifier.TERMS)) < 0.1)
    labels = (r.random(200) < 0.7).astype(int)
    model = quality_classifier.fit_matrix(x, labels, {0: 60, 1: 140})
    asked = np.abs(r.normal(size=(17, quality_classifier.TERMS)))
    found = quality_classifier.unit(asked.astype(np.float32) @ model.project)
    for i, score in enumerate(quality_classifier.vote(model, asked)):
        cosine = model.vectors @ found[i]
        near = np.argsort(-cosine)[: quality_classifier.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality_classifier.SHARPNESS * model.weights[near]
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-4
    assert quality_classifier.vote(model, np.zeros((1, quality_classifier.TERMS)))[0] == model.share


def test_classifier_on_awkward_tables(spark):
    good = [(i, prose(i, 60), "en", "s", 1) for i in range(40)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(i, 60).split()), "en", "s", 1) for i in range(40)]
    docs = documents(spark, good + bad + awkward_rows())
    labels = spark.createDataFrame([(r[0], 1) for r in good[:30]] + [(r[0], 0) for r in bad[:30]] + [(5000, 1), (None, 0)], "doc_id bigint, quality int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 for r in got if r.doc_id in {x[0] for x in good[30:]})
    assert all(r.predicted == 0 for r in got if r.doc_id in {x[0] for x in bad[30:]})
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert quality_classifier.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    assert {r.score for r in quality_classifier.predict(docs, None, ["doc_id"]).collect()} == {0.5}


# near-duplicates -------------------------------------------------------------------------------


def test_signatures_are_unbiased():
    r = np.random.default_rng(2)
    a = r.integers(1, 9, 40)
    b = np.where(r.random(40) < 0.6, a, r.integers(1, 9, 40))
    reps = 600
    shingle = r.integers(1, 1 << 62, (reps, 40)).astype(np.uint64)
    row = np.concatenate([np.repeat(np.arange(reps), 40) * 2, np.repeat(np.arange(reps), 40) * 2 + 1])
    sig = near_dedup.signatures(row, np.tile(shingle.reshape(-1), 2), np.concatenate([np.tile(a, reps), np.tile(b, reps)]), 2 * reps, 60)
    got = (sig[0::2] == sig[1::2]).mean()
    assert abs(got - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.012


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or jaccard(a, b) >= 0.8):
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        ids = best.setdefault(find(i), [])
        ids.append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in best.items()}
    return [(r[0], least[find(i)], len(best[find(i)])) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def copies():
    rows = awkward_rows()
    base = prose(7, 150)
    texts_ = [base, base, edited(base, [3]), edited(base, [90, 140]), edited(base, [3, 40, 80, 120, 149])]
    # Copies of copies: far from the base, linked through a chain.
    chain = [edited(base, list(range(0, 12 * k, 12))) for k in range(1, 9)]
    texts_ += chain + [prose(8, 150), base + " " + prose(9, 150), prose(7, 75), "one two", "w " * 40, "w " * 44]
    # Many texts around one original, far from each other.
    hub = prose(11, 100)
    texts_ += [edited(hub, [10 * k + 5]) for k in range(9)] + [edited(hub, [10 * k + 5, 10 * k + 50]) for k in range(4)]
    return rows + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts_)]


def test_near_duplicate_classes(spark, copies, monkeypatch):
    want = sorted(brute_classes(copies), key=str)
    docs = documents(spark, copies)
    got = near_dedup.classes(docs.withColumn("class_size", F.lit("old"))).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == want
    # Blocks of a few texts give the same classes.
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    got = near_dedup.classes(docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_one_of_each_class_stays(spark, copies):
    docs = documents(spark, copies).withColumns({"tid": F.lit(1), "n": F.lit(2), "k": F.lit(3), "root": F.lit(4)})
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    want = collections.Counter()
    seen = set()
    for row, (_, class_id, size) in zip(copies, brute_classes(copies)):
        if row[1] is None:
            want[row[0], None] += 1
        elif row[0] == class_id and (class_id, row[1]) not in seen:
            if row[0] is not None or size == 1:
                seen.add((class_id, row[1]))
                want[row[0], row[1]] += 1
    assert got == want


def test_block_links_join_components():
    import pandas as pd

    base = prose(3, 100)
    bodies = [base, edited(base, [1]), edited(base, [50]), prose(4, 100)]
    group = pd.DataFrame(
        {
            "tid": [bytes([i]) for i in range(4)],
            "root": [bytes([i]) for i in range(4)],
            "text": bodies,
            "probe": [True] * 4,
            "up": [False] * 4,
            "band": [0] * 4,
            "keys": [np.arange(3)] * 4,
        }
    )
    links = near_dedup._components_within(group)
    assert len(links) == 2
    assert {frozenset(x) for x in links.to_numpy().tolist()} <= {frozenset((bytes([i]), bytes([j]))) for i in range(3) for j in range(i)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (700, 701), (701, 700)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {700: 700, 701: 700}
    assert got == want
    assert components.roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# chat ---------------------------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string"
HOSTILE = ["\\### Assistant: </turn> ok", "</turn>\n<turn user>\n", "\\b\\l\\g", "a\\", "", None, "é\U0001f600<>", "\\\\l"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, "a<b>\\", "x"), (2, 1, None, "y"), (None, None, "user", "z"), (3, 5, "system", "s"), (3, 9, "user", "u")]
    rows += [(4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "user", "q"), (5, 1, "user", "r")]
    out = chat_format.transcripts(spark.createDataFrame(rows, CHAT).withColumn("loss", F.lit("other")))
    read = out.select(
        "conv_id",
        "valid",
        "error_turn",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    got = {r.conv_id: r for r in read.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].learned == "".join(t for role, t in turns if role == "assistant")
    assert got[1].valid and got[3].valid and got[None].valid
    assert not got[2].valid and got[2].error_turn == 0 and got[5].error_turn == 1 and got[4].error_turn == 1
    empty = spark.createDataFrame([], CHAT)
    assert chat_format.transcripts(empty).count() == 0 and chat_format.segments(empty).count() == 0


def test_segments_make_the_transcript(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HOSTILE)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, CHAT)
    whole = {r.conv_id: r.formatted for r in chat_format.transcripts(df).collect()}
    parts = collections.defaultdict(list)
    for r in chat_format.segments(df).collect():
        parts[r.conv_id].append((r.number, r.part, r.text, r.loss, r.allowed))
    for conv, text in whole.items():
        assert "".join(p[2] for p in sorted(parts[conv])) == text
    assert {p[3] for p in parts[2] if p[1] == 1} == {True} and not any(p[4] for p in parts[2])


def test_template_is_declarative(spark):
    template = chat_format.Template(
        open="<|{role}|>", close="<|end|>", loss_roles=("user",), follows={"": ("user",), "user": ("tool",), "tool": ("user",)}
    )
    rows = [(1, 0, "user", "a<|end|>"), (1, 1, "tool", "b")]
    out = chat_format.transcripts(spark.createDataFrame(rows, CHAT), template)
    read = out.select("valid", chat_format.read_turns(F.col("formatted"), template).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert read.valid and [tuple(t) for t in read.t] == [("user", "a<|end|>"), ("tool", "b")] and read.l == "a<|end|>"


# lines --------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def mutate(r, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(out)), r.random()
        if kind < 0.33:
            out.insert(i, r.choice("xyzé"))
        elif kind < 0.66:
            out.pop(i)
        else:
            out[i] = r.choice("xyzé")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(500):
        a = "".join(r.choice("abé ") for _ in range(r.choice([17, 20, 33, 70])))
        pairs.append((a, mutate(r, a, r.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(
        "a",
        "b",
        line_dedup.within(F.col("a"), F.col("b"), edits).alias("w"),
        line_dedup.may_be_within(F.col("a"), F.col("b"), edits).alias("m"),
        line_dedup.letters_near(line_dedup.letters(F.col("a")), line_dedup.letters(F.col("b")), edits).alias("n"),
    ).collect()
    for row in got:
        near = levenshtein(row.a, row.b) <= edits
        assert row.w == near
        assert not near or (row.m and row.n)


@pytest.mark.parametrize("block_lines", [1, 1000])
def test_line_links_equal_all_pairs(spark, block_lines):
    r = random.Random(5)
    bases = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (30, 31, 47, 90)]
    made = {mutate(r, b, r.randint(0, 4)) for b in bases for _ in range(25)} | set(bases)
    rows = [(i, t, None, None, None) for i, t in enumerate(sorted(made))]
    lines = line_dedup.distinct_lines(documents(spark, rows))
    ids = {x.id: x.line for x in lines.collect()}
    got = {frozenset((ids[x.a], ids[x.b])) for x in line_dedup.links(lines, 2, 30, block_lines).collect()}
    long = [t for t in made if len(t) >= 30 and words(t)]
    want = {frozenset((a, b)) for i, a in enumerate(long) for b in long[:i] if levenshtein(a, b) <= 2}
    assert got == want


@pytest.mark.parametrize("block_lines", [1, 1000])
def test_links_of_short_lines_equal_all_pairs(spark, block_lines):
    r = random.Random(7)
    bases = ["".join(r.choice("abcé ") for _ in range(n)) for n in (3, 4, 6, 9, 15, 17, 28)]
    made = {mutate(r, b, r.randint(0, 4)) for b in bases for _ in range(12)} | set(bases)
    made |= {"a", "b", "é", "ab", "ba", "cé", "\U00020000b", "abc", "abcd", "xyab", "wxyz", "Page 12 of 300", "Page 13 of 300"}
    made |= {b * 3 for b in bases[-2:]}
    rows = [(i, t, None, None, None) for i, t in enumerate(sorted(made))]
    lines = line_dedup.distinct_lines(documents(spark, rows))
    ids = {x.id: x.line for x in lines.collect()}
    got = [frozenset((ids[x.a], ids[x.b])) for x in line_dedup.links(lines, 2, block_lines=block_lines).collect()]
    all_lines = [t for t in sorted(made) if words(t)]
    want = {frozenset((a, b)) for i, a in enumerate(all_lines) for b in all_lines[:i] if levenshtein(a, b) <= 2}
    assert set(got) == want and len(got) == len(want)


def test_line_classes_on_awkward_rows(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    rows = awkward_rows() + [(50, f"{base}\nshort\n{base}s\n\n", None, None, None), (51, f"short\n{base[:-2]}", None, None, None), (None, base, None, None, None)]
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(documents(spark, rows)).collect()}
    assert got[50, 0].copies == 2 and got[50, 0].links == 2
    assert (got[50, 2].class_doc_id, got[50, 2].class_line_no) == (50, 0) == (got[51, 1].class_doc_id, got[51, 1].class_line_no)
    assert got[50, 1].copies == 2 and got[50, 1].links == 0
    distinct = {x for r in rows for x in (r[1] or "").split("\n") if words(x)}
    assert len(got) == len(distinct)
    assert line_dedup.line_classes(documents(spark, [])).count() == 0


def test_every_place_of_a_line_has_its_class(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    texts_ = {1: f"{base}\nalone here in one text", 2: f"\n{base}s\n{base}", 3: base, None: f"x\n{base}"}
    docs = documents(spark, [(k, t, None, None, None) for k, t in texts_.items()] + awkward_rows()[:1])
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_places(docs).collect()}
    want = {(k, n): x for k, t in texts_.items() for n, x in enumerate(t.split("\n")) if words(x)}
    assert got.keys() == want.keys()
    for place, line in want.items():
        near = line.startswith(base)
        assert got[place].length == len(line) and got[place].copies == list(want.values()).count(line)
        assert (got[place].class_doc_id, got[place].class_line_no) == ((1, 0) if near else place)
        assert (got[place].first_doc_id, got[place].first_line_no) == ((1, 0) if line == base else place)


def test_texts_without_repeated_lines(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"{base}\n\nfirst only"), (2, f"\n{base}s\nsecond text\n{base}"), (2, f"\n{base}s\nsecond text\n{base}"), (3, base), (4, None), (5, "")]
    rows += [(None, f"null id text\n{base}")]
    docs = documents(spark, [(*r, "en", None, 1) for r in rows])
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, f"{base}\n\nfirst only"), (2, "\nsecond text"), (2, ""), (3, ""), (4, None), (5, ""), (None, "null id text")]
    assert got == sorted(want, key=str)


# WARC ------------------------------------------------------------------------------------------------


def test_warc_round_trip_at_every_split(spark, tmp_path):
    r = random.Random(1)
    big = "".join(chr(r.randrange(32, 1000)) for _ in range(3000))
    magic = "\x1f\x08" * 600
    rows = [(i, f"http://x/{i}\r\nX: y", t) for i, t in enumerate([big, big, "small", "small", "", None, magic, magic + "x", big, prose(1, 9000)])]
    rows += [(None, None, "null id"), (3, "again", "small"), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write(warc.plan_records(pages).repartition(2), f"file://{tmp_path}/w")
    want = None
    for split in (64, 1000, 1 << 20):
        found = warc.read(archives, split)
        got = sorted(
            (str(x.page_id), x.record_type, str(x.refers_to), x.digest, x.full_length, bytes(x.payload or b""))
            for x in found.select(warc.page_number(F.col("record_id")).alias("page_id"), "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"), "digest", "full_length", "payload").collect()
        )
        want = want or got
        assert got == want and len(got) == len(rows)
    kept = {(x[0], x[1], x[2]) for x in want if x[4] == len(big.encode())}
    assert kept == {("8", "response", "None"), ("0", "revisit", "8"), ("1", "revisit", "8"), ("None", "revisit", "8")}
    assert all(x[5].decode() == (rows[int(x[0])][2] or "") for x in want if x[0] not in ("None", "3") and x[1] == "response")
    listed = warc.list_archives(spark, f"file://{tmp_path}/w")
    assert sorted(x.bytes for x in listed.collect()) == sorted(x.bytes for x in archives.collect() if x.bytes)


def test_warc_keeps_pages_with_long_urls(spark, tmp_path):
    r = random.Random(2)
    long = "data:," + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    text = prose(3, 400)
    rows = [(1, "http://x/1", text), (2, long, "small"), (3, long + "3", text), (4, "data:," + "a" * 3_000_000, "flat"), (5, "http://x/5", text)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.write(warc.plan_records(pages).repartition(1), f"file://{tmp_path}/w")
    for split in (1000, 1 << 20):
        got = {x.id: (x.target_uri, x.kind) for x in warc.read(archives, split).select(warc.page_number(F.col("record_id")).alias("id"), "target_uri", F.col("record_type").alias("kind")).collect()}
        assert got == {i: (u, "revisit" if i in (1, 3) else "response") for i, u, _ in rows}


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read(warc.write(warc.plan_records(pages), f"file://{tmp_path}/e")).count() == 0


def test_magic_inside_data_is_no_record():
    import io

    fake = warc.GZIP_MAGIC + b"\x00" * 20
    one = warc.encode_record(1, "u", fake * 50, "d", 5, None)
    two = warc.encode_record(2, "u", b"x", "d", 1, None)
    data = fake + one + fake + two + one[:40]
    for cut in range(0, len(data), 7):
        ids = []
        for start, end in ((0, cut), (cut, len(data))):
            ids += [x.headers["warc-record-id"] for x in warc.records_in(io.BytesIO(data), len(data), start, end)]
        assert ids == ["<urn:page:1>", "<urn:page:2>"]


# decontamination ----------------------------------------------------------------------------------------


def test_all_neighbours_within_radius_are_indexed():
    r = np.random.default_rng(0)
    mark = r.integers(0, 1 << 62, 300).astype(np.uint64)
    for x in mark[:50]:
        flips = r.choice(64, decontamination.RADIUS, replace=False)
        y = x ^ np.uint64(sum(1 << int(f) for f in flips))
        hit = False
        for b in range(decontamination.BLOCKS):
            bits = decontamination._BIT_EDGES[b + 1] - decontamination._BIT_EDGES[b]
            near = decontamination._block(np.array([x]), b)[0] ^ decontamination._near(bits)
            hit |= decontamination._block(np.array([y]), b)[0] in near
        assert hit


def brute_matches(text, item):
    w, v = words((text or "").lower()), words((item or "").lower())
    n = len(v)
    if not n or len(w) < n:
        return None
    return max(jaccard(" ".join(w[i : i + n]), " ".join(v)) for i in range(len(w) - n + 1))


def test_matches_equal_all_windows(spark):
    items = [(i, prose(100 + i, n)) for i, n in enumerate((3, 5, 18, 40, 40, 60))] + [(90, None), (91, ""), (None, prose(500, 30)), (92, "w w w w w w w w")]
    long = items[3][1]
    bodies = [f"{prose(1, 30)} {t} {prose(2, 30)}" for _, t in items if t] + [items[5][1], long[: len(long) // 2], edited(long, [39]), edited(long, [0, 39])]
    bodies += [f"{prose(3, 9)} {long.upper()}", f"{long} {long}", prose(9, 300), "w " * 30]
    rows = awkward_rows() + [(1000 + i, t, None, None, None) for i, t in enumerate(bodies)]
    docs = documents(spark, rows).withColumn("matches", F.lit("old"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("i", F.lit(1))
    found = decontamination.with_matches(docs, bench).collect()
    assert len(found) == len(rows)
    for row in found:
        want = {i: s for i, t in items if (s := brute_matches(row.text, t)) is not None and s >= 0.8}
        assert {m.item_id: round(m.similarity, 9) for m in row.matches} == {i: round(s, 9) for i, s in want.items()}
    assert all(not r.matches for r in decontamination.with_matches(docs, bench.limit(0)).collect())
    assert decontamination.with_matches(docs.limit(0), bench).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(9)]
    docs = documents(spark, [(i, f"x {t}", None, None, None) for i, t in items])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    got = decontamination.with_matches(docs, bench).select("doc_id", "matches.item_id").collect()
    assert all(r.item_id == [r.doc_id] for r in got)


# mixing ---------------------------------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, left, out = sum(sizes.values()), set(names), {}
    while True:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        out |= {s: epochs * sizes[s] for s in over}
        left -= over


def test_water_filling(spark):
    for seed in range(4):
        r = random.Random(seed)
        sizes = {f"s{i:02d}": r.choice([1, 5, 40, 1000]) * r.randint(1, 9) for i in range(r.randint(1, 12))} | {None: 7}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * (i % 23), None, None if i % 10 == 0 else f"s{i % 4}" if i % 3 else "s0", None) for i in range(900)]
    rows += rows[:50]
    docs = documents(spark, rows).select("doc_id", "source", texts.word_count(F.col("text")).alias("size")).withColumn("times", F.lit(1))
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken == r.times * r.size and 0 <= r.times <= 3
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 23
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    repeated = collections.Counter(r.doc_id for r in mixing.repeat(out).collect())
    assert sum(repeated.values()) == sum(r.times for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_rows(documents(spark, awkward_rows()).withColumn("target", F.lit("x")))
    assert mixed.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ") + ["target"]


def test_mix_of_null_and_repeated_ids_by_slices(spark):
    rows = [(None, "s0" if i % 3 else "s1", i % 7, f"text {i}") for i in range(400)] + [(5, "s1", 3, f"{i}") for i in range(200)]
    rows += [(i, f"t{i % 5}", 4, "x") for i in range(300)] + [(None, None, 2, "none")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, text string").withColumn("_row", F.lit("own"))

    def taken(df, **options):
        return sorted(map(str, mixing.mix(df, **options).select("doc_id", "source", "size", "text", "_row", "times").collect()))

    usual = taken(docs)
    assert len(usual) == len(rows) and taken(docs.repartition(7)) == usual
    # Bins above the limit take the other route, to the same result.
    assert taken(docs, hot_rows=10) == usual
    by = collections.defaultdict(list)
    for r in mixing.mix(docs, hot_rows=10).collect():
        by[r.source].append(r)
    assert all(abs(sum(r.taken for r in own) - own[0].target) <= 7 for own in by.values())


# languages ---------------------------------------------------------------------------------------------------


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 5, 9, 40):
        code = language_id.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= max(1, code.shape[1] // 5)


def test_language_on_awkward_tables(spark):
    r = random.Random(0)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno", None: "pqrst"}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 4]
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(5)) for _ in range(12)), lang, "s", 1))
    docs = documents(spark, rows + awkward_rows()).withColumn("score", F.lit("old"))
    model = language_id.fit(docs.filter("doc_id < 160 AND lang <> 'en'"), keys=["doc_id"])
    assert model.languages == ["aa", "bb", "cc"]
    got = language_id.predict(docs, model, ["doc_id", "lang", "text"]).collect()
    assert len(got) == docs.count()
    for row in got:
        letter = any(ch.isalpha() for ch in row.text or "")
        assert (row.lang_pred == "und") == (not letter) and 0 <= row.score <= 1
        if row.doc_id is not None and row.doc_id >= 160 and row.lang in model.languages:
            assert row.lang_pred == row.lang
    assert language_id.fit(docs.limit(0)) is None
    assert {x.lang_pred for x in language_id.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_every_language_is_learned(spark):
    r = random.Random(4)
    kinds = {f"l{i:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for i in range(300)}
    rows = [(i * 8 + n, " ".join(r.choice(v) for _ in range(30)), k, "s", 1) for i, (k, v) in enumerate(kinds.items()) for n in range(8)]
    docs = documents(spark, rows)
    hot = spark.range(8000).selectExpr("7L AS doc_id", "concat('zz zzz ', id) AS text", "'zz' AS lang", "'s' AS source", "1L AS n_chars")
    model = language_id.fit(docs.filter("doc_id % 8 < 6").unionByName(hot), keys=["doc_id"])
    assert model.languages == [*sorted(kinds), "zz"]
    got = language_id.predict(docs.filter("doc_id % 8 >= 6"), model, ["lang"]).collect()
    assert sum(x.lang == x.lang_pred for x in got) / len(got) > 0.95
