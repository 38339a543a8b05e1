"""Thresholds and labels against the pairwise and the sequential definitions."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import calibration as K


@pytest.mark.parametrize("values", [5, 1000])
def test_curve_is_the_pairwise_definition(spark, values):
    rng = random.Random(values)
    rows = [(rng.randrange(values) / values, rng.random() < 0.3) for _ in range(600)] + [(None, True), (0.5, None)]
    got = K.threshold_curve(spark.createDataFrame(rows, "score double, same boolean")).collect()
    sound = [r for r in rows if None not in r]
    good, bad = ([s for s, same in sound if same is x] for x in (True, False))
    auc = sum((x > y) + 0.5 * (x == y) for x in good for y in bad) / (len(good) * len(bad))
    assert {r.threshold for r in got} == {s for s, _ in sound}
    for r in got:
        above = [same for s, same in sound if s >= r.threshold]
        assert r.n == len(above) and abs(r.precision - sum(above) / len(above)) < 1e-12 and abs(r.recall - sum(above) / len(good)) < 1e-12 and abs(r.auc - auc) < 1e-12


def test_curve_of_one_kind_and_of_nothing(spark):
    rows = spark.createDataFrame([(0.1, True), (0.2, True)], "score double, same boolean")
    assert [(r.recall, r.auc) for r in K.threshold_curve(rows).orderBy("threshold").collect()] == [(1.0, None), (0.5, None)]
    assert [(r.recall, r.auc) for r in K.threshold_curve(rows.withColumn("same", F.lit(False))).collect()] == [(None, None)] * 2
    assert K.threshold_curve(rows.where("false")).count() == 0


def test_pair_scores_leave_out_what_has_no_angle(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 2.0], 1), (3, [3.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    assert {tuple(r) for r in K.pair_scores(df, df, "id", "v", "label").collect()} == {(0.0, True, 2), (0.0, False, 2), (1.0, False, 2)}
    assert K.pair_scores(df.where("false"), df, "id", "v", "label").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_labels_as_one_pair_after_the_other(spark, seed):
    rng = random.Random(seed)
    members = [(i, rng.randrange(9), rng.choice([None, *range(6)])) for i in range(120)] + [(None, 1, 1)]
    new = spark.createDataFrame([(k, a) for k, a, _ in members], "k long, cluster long")
    old = spark.createDataFrame([(k, b) for k, _, b in members], "k long, cluster long")
    got = {r.new: (r.old, r.n) for r in K.align_labels(new, old, "k").collect()}
    counts = {}
    for k, a, b in members:
        if k is not None and b is not None:
            counts[a, b] = counts.get((a, b), 0) + 1
    want = {}
    for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if a not in want and b not in {o for o, _ in want.values()}:
            want[a] = (b, n)
    free = (i for i in range(100) if i not in {o for o, _ in want.values()})
    for a in sorted({a for k, a, _ in members if k is not None} - set(want)):
        want[a] = (next(free), 0)
    assert got == want
