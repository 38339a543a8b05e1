"""Range pairs are dealt by how many they are."""

import random

from attestor.operators import linking as L


def test_a_large_group_is_cut_and_no_pair_is_lost(spark):
    rng = random.Random(4)
    rows = [(1 if i % 3 else i % 7, i, s := rng.randrange(90), s + rng.randrange(20)) for i in range(400)] + [(None, 900, 1, 2), (None, 901, 5, 6), (1, 902, None, 3), (1, 903, 80, None)]
    df = spark.createDataFrame(rows, "g int, k long, t_start int, t_end int")
    want = sorted((g, k, m) for g, k, _, e in rows for h, m, s, _ in rows if g is not None and g == h and e is not None and s is not None and e < s)
    out = L.before_pairs(df, "g", "k", most=2_000)
    got = out.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect()
    assert sorted(p for part in got for p in part) == want
    assert max(map(len, got)) < len(want) / 4  # one task did the largest group before
