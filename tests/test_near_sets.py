"""Near shingle sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import linking as L


def test_near_sets_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    notice = [f"n{i}" for i in range(12)]
    texts = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    texts += [[w if rng.random() > 0.15 else "v" for w in rng.choice(texts)] for _ in range(80)]
    known = dict(enumerate({frozenset(t + notice if i % 3 == 0 else t) for i, t in enumerate(texts)}))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in known.items()], "i long, w array<string>").select(F.struct(F.col("i").alias("x"), F.col("i").alias("y")).alias("set"), F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("sh"))
    want = {(i, j): len(s & t) / len(s | t) for i, s in known.items() for j, t in known.items() if i != j and len(s & t) / len(s | t) >= 0.45}
    got = [(r.a.x, r.b.x, r.similarity) for r in L.near_sets(df).collect()]
    assert len(got) == len(want) and {(a, b): v for a, b, v in got} == pytest.approx(want)
