"""Small stories are settled in one task, large ones by rounds: with the same result."""

import random
from datetime import datetime, timedelta

from attestor.operators.timeline import ordered_timeline

DAY = datetime(2024, 1, 1)


def test_both_routes_agree(spark):
    rng = random.Random(3)
    day = lambda n: None if n is None else DAY + timedelta(days=n)
    starts = {(s, k): rng.choice([None, *range(8)]) for s in range(3) for k in range(6)}
    events = [(s, k, day(a), None if a is None else day(a + rng.randrange(6))) for (s, k), a in starts.items()]
    relations = [(s, rng.randrange(6), rng.randrange(6)) for s in range(3) for _ in range(7)]
    e = spark.createDataFrame(events, "story_id long, canonical_id long, t_start timestamp, t_end timestamp")
    r = spark.createDataFrame(relations, "story_id long, earlier long, later long")
    inside, rounds = ([sorted(map(tuple, df.collect()), key=repr) for df in ordered_timeline(e, r, in_task=n)] for n in (100, 0))
    assert inside == rounds and inside[1]
