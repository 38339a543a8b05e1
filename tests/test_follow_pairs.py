"""Readers and articles meet at the least key they share: no pair is gathered, none is lost."""

import random

import pytest

from attestor.operators import linking as L
from attestor.operators import names as N


@pytest.mark.parametrize("most", [50, 50_000_000])
def test_pairs_arise_once(spark, most):
    rng = random.Random(8)
    sides = [[(i, [min(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(6))]) for i in range(n)] for n in (90, 130)]
    one, two = (spark.createDataFrame([(i, sorted(set(k))) for i, k in rows], f"{c} long, keys array<long>") for c, rows in zip("ab", sides))
    want = sorted((i, j, sorted(set(k) & set(m))) for i, k in sides[0] for j, m in sides[1] if set(k) & set(m))
    out = L.pairs_of_shared_keys(one, two, "a", "b", most=most)
    assert sorted((r.a, r.b, sorted(r.shared)) for r in out.collect()) == want
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # pairs were made distinct by a shuffle before


def test_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(i, f"w{i} of the word{i % 7} w{i + 1}") for i in range(50)], "k long, text string")
    phrases = spark.createDataFrame([(f"word{i}  W{i + 1}",) for i in range(30)] + [("of the",), ("the nowhere",)], "phrase string")
    out = N.phrase_matches(phrases, texts, "k", "text", most=4)
    assert {tuple(r) for r in out.collect()} == {(f"word{i}  W{i + 1}", i) for i in range(7)} | {("of the", k) for k in range(50)}
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
