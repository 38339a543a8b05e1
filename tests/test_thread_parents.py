"""Parents by shared words and names against a plain version."""

import random

import pytest

from attestor.operators import linking as L


@pytest.mark.parametrize("strip, block, n", [(30, 7, 160), (1000, 16, 90), (1000, 100, 40)])
def test_parents_share_a_name_and_are_no_daughters(spark, strip, block, n):
    rng = random.Random(n)
    rows = [(3 * i, [f"w{min(rng.randrange(25), rng.randrange(25))}" for _ in range(rng.randrange(12))], [f"N{min(rng.randrange(9), rng.randrange(9))}" for _ in range(rng.randrange(3))]) for i in range(n)] + [(900, None, None), (901, ["a", "b", "c"], ["Z"])]
    daughters = [(3 * rng.randrange(n), 3 * rng.randrange(n)) for _ in range(6 * n)]
    want = set()
    for k, words, names in rows:
        met = sorted((-len(set(words or ()) & set(u or ())), j) for j, u, m in rows if j < k and set(names or ()) & set(m or ()) and (j, k) not in daughters)
        want |= {(k, j, -s) for s, j in [m for m in met if m[0] <= -3][:6]}
    df = spark.createDataFrame(rows, "k long, words array<string>, names array<string>")
    got = [tuple(r) for r in L.parents_by_names(df, "k", "words", "names", spark.createDataFrame(daughters, "child long, parent long"), strip=strip, block=block).collect()]
    assert set(got) == want and len(got) == len(want) and len({c for c, _, _ in want}) > 5
