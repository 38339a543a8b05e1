"""Weighted Jaccard of all pairs of units, in strips and blocks."""

import math
import random

from attestor.operators import corroboration as C
from attestor.plans.catalog import ORACLE, QUERIES


def test_all_pairs_are_returned(spark):
    rng = random.Random(3)
    units = {u: {rng.choice(["a", "b", "c", "d", None]): rng.randrange(1, 6) for _ in range(rng.randrange(1, 4))} for u in range(70)} | {u: {"a": 2, "z": 1} for u in range(100, 130)}
    counts = spark.createDataFrame([(u, k, n) for u, p in units.items() for k, n in p.items()], "u long, k string, n long")
    want = {}
    for a, p in units.items():
        for b, q in units.items():
            low = sum(min(p[k], q[k]) for k in p.keys() & q.keys() if k)
            if a < b and low:
                want[a, b] = math.floor(abs(s := 2 * low / (sum(p.values()) + sum(q.values()) - low) - 1) * 1e6 + 0.5) / 1e6 * math.copysign(1, s)
    got = [tuple(r) for r in C.weighted_jaccard_pairs(counts, "u", "k", "n", strip=40, block=7).collect()]
    assert {g[:2]: g[2] for g in got} == want and len(got) == len(want)


def test_the_query_keeps_pairs_of_equal_counts(spark, tmp_path):
    assert "kind" not in QUERIES["weighted_jaccard_voices"](spark, "/root/testdata/sf0.001").columns and "'same'" not in ORACLE["weighted_jaccard_voices"]
