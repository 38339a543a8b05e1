"""Positions: a plain fit by gradient steps, planted sides, shuffled sides, items."""

import random

import numpy as np

from attestor.operators import positions as P

ITEMS = "story_id long, type string, item string, unit string, y int"


def camps(at_random, seed=1, stories=60):
    """Eight sources in two camps, each leaving out what is inconvenient to it, or at random."""
    rng = random.Random(seed)
    rows = []
    for story in range(stories):
        for fact in range(4):
            for k in range(8):
                left_out = rng.random() < 0.5 if at_random else ((k < 4) != (fact % 2 == 0) and rng.random() < 0.85)
                rows.append((story, "omission", str(fact), f"O{k}", int(not left_out)))
    return rows


def plain_fit(rows, units, steps=60000):
    """All parameters by small gradient steps at once, the scale renewed after each."""
    items = {k: i for i, k in enumerate(sorted({r[:3] for r in rows}))}
    i = np.array([items[r[:3]] for r in rows])
    u = np.array([units.index(r[3]) for r in rows])
    y = np.array([r[4] for r in rows], float)
    a, b, theta = np.zeros(len(items)), np.zeros(len(items)), P.start(units)
    for _ in range(steps):
        r = y - 1 / (1 + np.exp(-(a[i] + b[i] * theta[u])))
        a, b, before = a + 0.1 * (np.bincount(i, r) - P.HOLD_A * a), b + 0.1 * (np.bincount(i, r * theta[u]) - P.HOLD_B * b), theta
        theta = P._standard(theta + 0.02 * (np.bincount(u, r * b[i]) - theta))
        if np.abs(theta - before).max() < 1e-13:
            break
    return theta


def test_fit_is_that_of_plain_gradient_steps(spark):
    rows = camps(False, stories=20)
    got = {r.unit: r.theta for r in P.ideal_points(spark.createDataFrame(rows, ITEMS)).collect()}
    units = sorted(got)
    want = plain_fit(rows, units)
    theta = np.array([got[u] for u in units])
    assert min(np.abs(theta - want).max(), np.abs(theta + want).max()) < 1e-6
    assert abs(theta.mean()) < 1e-9 and abs(theta.std() - 1) < 1e-9
    assert all((got[f"O{k}"] > 0) == (got["O0"] > 0) for k in range(4)) and all((got[f"O{k}"] > 0) != (got["O0"] > 0) for k in range(4, 8))


def test_planted_sides_are_a_signal_and_chance_is_none(spark):
    one = P.position_test(spark.createDataFrame(camps(False), ITEMS), rounds=8, shuffles=2).first()
    assert one.signal and one.r > 0.95 and (one.stories, one.items, one.units) == (60, 240, 8)
    other = P.position_test(spark.createDataFrame(camps(True), ITEMS)).first()
    assert not other.signal


def test_few_units_and_empty_tables(spark):
    few = spark.createDataFrame([r for r in camps(False) if r[3] < "O3"], ITEMS)
    row = P.position_test(few).first()
    assert row.units == 3 and row.r is None and not row.signal
    assert P.ideal_points(few).count() == 3
    none = few.where("false")
    assert P.ideal_points(none).count() == 0 and P.position_test(none).first().items == 0


def test_names_are_permuted_within_stories(spark):
    """A shuffled set has the answers of each item under other names, the same for all items of a story."""
    rows = [(s, "stance", str(i), f"u{k}", (k + i) % 2) for s in range(3) for i in range(2) for k in range(6)]
    units = [f"u{k}" for k in range(6)]
    sheets = P.answer_sheets(spark.createDataFrame(rows, ITEMS), units, shuffles=2, rounds=3).collect()
    assert len(sheets) == 3 * 2 * 3
    for answers in range(3):
        for story in range(3):
            mine = [{a.number: a.y for a in r.sheet} for r in sheets if r.answers == answers and r.story_id == story]
            assert all(sorted(m) == list(range(6)) and sum(m.values()) == 3 for m in mine)
            assert all(mine[0][k] != mine[1][k] for k in range(6))
    weights = {(r.answers, r.story_id): list(r.weights) for r in sheets}
    assert all(len(w) == 3 and min(w) >= 0 for w in weights.values()) and len({tuple(w) for w in weights.values()}) > 1


def test_four_kinds_of_items(spark):
    told = spark.createDataFrame([(1, 10, u, d) for u, d in (("a", False), ("b", True), ("c", False), ("c", False))] + [(1, 11, u, False) for u in "abc"] + [(2, 20, "a", True), (2, 20, "b", False)], "story_id long, item long, unit string, denies boolean")
    omissions = spark.createDataFrame([(1, 10, "a", True), (1, 10, "b", False), (1, 10, "c", False), (1, 11, "a", True), (1, 11, "b", True), (1, 11, "c", True), (3, 30, "a", True), (3, 30, "b", False)], "story_id long, item long, unit string, told boolean")
    frames = spark.createDataFrame([(1, 11, "riot", "a"), (1, 11, "clash", u := "a"), (1, 11, "clash", "b"), (1, 11, "clash", "c"), (1, 10, "riot", "b")], "story_id long, item long, word string, unit string")
    voices = spark.createDataFrame([(1, "mayor", "a"), (1, "mayor", "b"), (1, "police", "c"), (2, "mayor", "a")], "story_id long, voice string, unit string")
    got = {(r.story_id, r.type, r.item): {} for r in P.position_items(told, omissions, frames, voices).collect()}
    for r in P.position_items(told, omissions, frames, voices).collect():
        got[r.story_id, r.type, r.item][r.unit] = r.y
    assert got == {
        (1, "stance", "10"): {"a": 1, "b": 0, "c": 1},
        (1, "omission", "10"): {"a": 1, "b": 0, "c": 0},
        (1, "framing", "11 riot"): {"a": 1, "b": 0, "c": 0},
        (1, "framing", "10 riot"): {"a": 0, "b": 1, "c": 0},
        (1, "voices", "mayor"): {"a": 1, "b": 1, "c": 0},
        (1, "voices", "police"): {"a": 0, "b": 0, "c": 1},
    }
