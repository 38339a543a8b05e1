"""MinHash signatures in numpy against plain integers."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from attestor.functions import text as X


def test_remainders_without_division():
    x = np.array([0, 1, X.PRIME - 1, X.PRIME, X.PRIME + 1, 2 * X.PRIME, X.PRIME**2, (X.PRIME - 1) ** 2 + 64 * 7919, 2**63 - 1], dtype=np.uint64)
    assert X._mod_prime(x).tolist() == [int(v) % X.PRIME for v in x]


def test_signatures_are_those_of_plain_integers(spark):
    rows = [(1, "Ab é काम_1 x y z, ab É काम_1 x y z"), (2, "two words"), (3, ""), (4, None), (5, " ".join(f"w{i % 70}" for i in range(3000)))]
    df = spark.createDataFrame(rows, "k long, text string").select("k", X.words(F.col("text")).alias("t"))
    out = df.select("k", "t", X.minhash(F.col("t")).alias("sig"))
    for r in out.collect():
        if r.t is None:
            assert r.k == 4 and r.sig is None
            continue
        runs = {" ".join(r.t[i : i + 5]) for i in range(max(1, len(r.t) - 4))}
        h = [int(md5(s.encode()).hexdigest()[:8], 16) % X.PRIME for s in runs]
        assert r.sig == [min(((i * 1103515245 + 12345) % X.PRIME * v + i * 7919) % X.PRIME for v in h) for i in range(1, 65)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # 64 nested functions over every shingle
