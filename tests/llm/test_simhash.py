"""SimHash near-duplicates against brute force: fingerprints, pairs, hot keys and components."""

import random
import re

import pytest
import xxhash

from tesserae.llm import simhash_dedup

DOCS = "doc_id bigint, text string, fp string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def texts_of(seed):
    r = random.Random(seed)
    made = [None, "", " \n\t", "one", "One TWO", "É é one two", "a\x0bb\x0cc\rd e", "é\x1cx " * 9, "ÀB " * 50]
    for _ in range(12):
        words = ["".join(r.choice("abcdeXYZé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(5, 120))]
        made.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            other[r.randrange(len(other))] += "q"
            made.append("  ".join(other).upper() if r.random() < 0.3 else "\n".join(other))
    return made + made[:4] + ["long words " + "w" * 200_000 + " " + "x y z " * 60_000]


def test_fingerprints_and_components(spark):
    sample = texts_of(1)
    docs = spark.createDataFrame([(100 - i, t, "kept") for i, t in enumerate(sample)], DOCS)
    rows = simhash_dedup.components(docs).collect()
    prints = [brute_print(t) for t in sample]
    assert {r.doc_id: r.fingerprint for r in rows} == {100 - i: f"{p:016x}" for i, p in enumerate(prints)}
    group = brute_components(prints)
    least = {g: min(100 - i for i, h in enumerate(group) if h == g) for g in set(group)}
    assert {r.doc_id: r.component_id for r in rows} == {100 - i: least[g] for i, g in enumerate(group)}
    assert {r.fp for r in rows} == {"kept"} and len(rows) == len(sample)


@pytest.mark.parametrize("hot", [1, 6, 256])
def test_classes_of_random_fingerprints(spark, monkeypatch, hot):
    """Clusters of near values, chains, and far values, with keys above and below the limit."""
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    r = random.Random(hot)
    prints = [0, (1 << 64) - 1, 1 << 63] + [r.getrandbits(64) for _ in range(20)]
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(25):
            value = centre
            for _ in range(r.randint(0, 5)):
                value ^= 1 << r.randrange(64)
            prints.append(value)
    for _ in range(30):  # a chain
        prints.append(prints[-1] ^ sum(1 << b for b in r.sample(range(64), 4)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id bigint, fp bigint")
    got = {x.doc_id: x.component_id for x in simhash_dedup.classes(df, "fp").collect()}
    group = brute_components(prints)
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_keys_cover_every_pair_within_the_radius():
    for count in (10, 10**8, 10**11, 10**14):
        masks = simhash_dedup.plan(count)
        r = random.Random(count)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flips & m for m in masks)
    assert len(simhash_dedup.plan(10)) == 35 and len(simhash_dedup.plan(10**14)) == 210


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e", "x"), (None, "a b c d e", "x"), (3, "A b C d e", "y"), (3, "a b c d e", "z"), (None, "lone", "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("fp", "component_id")
    got = sorted((r.doc_id is None, r.component_id) for r in simhash_dedup.components(docs).collect() if r.text != "lone")
    assert got == [(False, 3), (False, 3), (True, 3), (True, 3)]
    lone = [r for r in simhash_dedup.components(docs).collect() if r.text == "lone"]
    assert [r.component_id for r in lone] == [None]
    assert simhash_dedup.components(spark.createDataFrame([], DOCS)).count() == 0
