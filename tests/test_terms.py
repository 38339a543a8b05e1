"""Rows that share terms, told without pairs of rows, against plain versions."""

import random

from attestor.operators import linking as L


def titles(spark, seed, n=160):
    rng = random.Random(seed)
    rows = [(i, rng.choice([True, False, None, False]), sorted({f"w{min(rng.randrange(14), rng.randrange(14))}" for _ in range(rng.randrange(8))})) for i in range(n)]
    rows += [(n + i, i % 2 == 0, ["a", "b", "c", "d"]) for i in range(60)] + [(n + 60, False, None)]
    return rows, spark.createDataFrame(rows, "k long, home boolean, terms array<string>")


def test_rows_without_a_home_row_of_two_terms(spark):
    rows, df = titles(spark, 1)
    rows, df = [*rows, (900, False, ["a", "w0x"]), (901, False, ["a", "b"])], df.union(spark.createDataFrame([(900, False, ["a", "w0x"]), (901, False, ["a", "b"])], df.schema))
    want = {k for k, h, t in rows if h is False and not any(g and len(set(t or ()) & set(u)) >= 2 for _, g, u in rows)}
    assert {r.k for r in L.held_without_home(df, "k", "home", "terms").collect()} == want and 900 in want and 901 not in want
    out = L.held_without_home(df, "k", "home", "terms")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in out  # home rows are only asked whether they are there


def test_parents_are_the_first_of_those_that_share_most(spark):
    rows, df = titles(spark, 2)
    want = set()
    for k, _, t in rows:
        met = sorted((-len(set(t or ()) & set(u or ())), j) for j, _, u in rows if j < k)
        want |= {(k, j, -n) for n, j in [m for m in met if m[0] <= -3][:6]}
    got = [tuple(r) for r in L.parents_by_terms(df, "k", "terms").collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(n > 3 for _, _, n in want)


def test_pairs_that_share_terms_arise_once(spark):
    rows, df = titles(spark, 3)
    one, two = df.where("home").selectExpr("k AS a", "terms"), df.where("NOT home").selectExpr("k AS b", "terms")
    want = sorted((i, j, len(set(t) & set(u or ()))) for i, h, t in rows if h for j, g, u in rows if g is False and len(set(t) & set(u or ())) >= 2)
    out = L.shared_terms(one, two, "a", "b")
    assert sorted(tuple(r) for r in out.collect()) == want
    assert "Aggregate" not in out._jdf.queryExecution().sparkPlan().toString()  # pairs are not gathered
