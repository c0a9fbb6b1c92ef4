"""Counts of prefixes around their limits."""

from tesserae.operators import codebook


def test_prefix_counts_at_and_below_the_limit(spark):
    rows, sample = [], 0

    def add(times, *codes):
        nonlocal sample
        for _ in range(times):
            rows.extend((sample, pos, code) for pos, code in enumerate(codes))
            sample += 1

    add(24, 7)  # one short of the limit
    add(22, 8)
    add(3, 8, 1)  # together at the limit of one token, and at that of two
    add(2, 9, 1)  # one short of two tokens
    add(30, 0, 0, 0)
    tokens = spark.createDataFrame(rows, "sample_key bigint, pos bigint, code bigint")
    one = {r.prefix: r.n for r in codebook.prefix_counts(tokens, 1, 25).collect()}
    two = {r.prefix: r.n for r in codebook.prefix_counts(tokens, 2, 3).collect()}
    assert one == {"8": 25, "0": 30}
    assert two == {"8,1": 3, "0,0": 30}
    assert codebook.prefix_counts(tokens, 4, 1).count() == 0
