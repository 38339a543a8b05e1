"""Range pairs in groups of all sizes: none is lost, and a row is shuffled once where its group is not cut."""

import random
from datetime import datetime, timedelta

import pytest

from attestor.operators import linking as L


@pytest.mark.parametrize("most", [40, 10_000_000])
def test_pairs_of_small_and_large_groups(spark, most):
    rng = random.Random(most)
    day = datetime(2024, 1, 1)
    rows = [(f"g{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}", i, s := day + timedelta(hours=rng.randrange(40)), s + timedelta(hours=rng.randrange(9))) for i in range(500)]
    rows += [(None, 900, day, day), ("g0", 901, None, day), ("g0", 902, day + timedelta(hours=30), None), ("one", 903, day, day)]
    df = spark.createDataFrame(rows, "g string, k long, t_start timestamp, t_end timestamp")
    want = sorted((g, k, m) for g, k, _, e in rows for h, m, s, _ in rows if g and g == h and e and s and e < s)
    out = L.before_pairs(df, "g", "k", most=most)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 1000
    plan = out._jdf.queryExecution()
    assert "ReusedExchange" in plan.executedPlan().toString()  # both sides were shuffled before, one of them once for every part
