"""Timelines ordered by the clock and by stated relations.

One event comes before another if it ends before the other starts, or if a relation says so.  The order by the clock has n * n pairs
and is never written down: it is met by extremes (does anything start after this end?) and by sweeps in the order of time.
Only relations are edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.operators.linking import nearest_in_time
from attestor.plans.durable import checkpointed

_SPANS = "s long, k long, a long, b long"
#: Stories with at most as many events, and as many relations, are settled each in one task; larger ones by rounds over all of them.
IN_TASK = 5000


def _spans(events: DataFrame, story: str, key: str, start: str, end: str) -> DataFrame:
    """(s, k, a, b) in microseconds; a missing end is the start, and without a start there is neither."""
    return events.select(
        F.col(story).cast("long").alias("s"),
        F.col(key).cast("long").alias("k"),
        F.unix_micros(F.col(start)).alias("a"),
        F.unix_micros(F.when(F.col(start).isNotNull(), F.coalesce(F.col(end), F.col(start)))).alias("b"),
    )


def relation_edges(spans: DataFrame, relations: DataFrame, story: str, earlier: str, later: str) -> DataFrame:
    """(s, x, y, x_a, x_b, y_a, y_b): relations between two events of a story, each once, with the times of both."""
    r = relations.select(F.col(story).cast("long").alias("s"), F.col(earlier).cast("long").alias("x"), F.col(later).cast("long").alias("y")).where("x <> y").distinct()
    side = lambda n: spans.select("s", F.col("k").alias(n), F.col("a").alias(f"{n}_a"), F.col("b").alias(f"{n}_b"))
    return r.join(side("x"), ["s", "x"]).join(side("y"), ["s", "y"])


def _on_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when those that nothing leads to, or that lead to nothing, are taken away, again and again.

    From an edge one goes on to those that begin at its later event, or at an event that starts after that has ended.
    """
    core = checkpointed(edges)
    while True:
        far = core.groupBy("s").agg(F.max("x_a").alias("last_start"), F.min("y_b").alias("first_end"))
        heads = core.select("s", F.col("x").alias("y")).distinct().withColumn("__on", F.lit(True))
        tails = core.select("s", F.col("y").alias("x")).distinct().withColumn("__from", F.lit(True))
        met = core.join(far, "s").join(heads, ["s", "y"], "left").join(tails, ["s", "x"], "left")
        goes_on = F.coalesce("__on", F.lit(False)) | F.coalesce(F.col("y_b") < F.col("last_start"), F.lit(False))
        comes = F.coalesce("__from", F.lit(False)) | F.coalesce(F.col("first_end") < F.col("x_a"), F.lit(False))
        left = checkpointed(met.where(goes_on & comes).select(*core.columns))
        before, after = core.count(), left.count()
        core = left
        if after == before or after == 0:
            return core


def dropped_relations(edges: DataFrame) -> DataFrame:
    """(s, x, y) of the relations that contradict the rest.

    Relations are taken in order (earlier, later): each that still closes a cycle with the clock and with the relations not dropped
    yet is dropped; the clock never is.  Edges that can be on no cycle are trimmed first; then, in all stories at once, the first edge left is followed forward: what it
    reaches is kept as edges and one time, after whose passing everything that starts is reached.
    """
    against = F.coalesce(F.col("y_b") < F.col("x_a"), F.lit(False))
    gone = checkpointed(edges.where(against).select("s", "x", "y"))
    core = _on_cycles(edges.where(~against))
    while not core.isEmpty():
        first = core.groupBy("s").agg(F.min(F.struct("x", "y", "y_b")).alias("e")).select("s", F.col("e.x").alias("px"), F.col("e.y").alias("py"), F.col("e.y_b").alias("p_b"))
        start = core.join(first.select("s", "px"), "s").where("x = px").groupBy("s").agg(F.max("x_a").alias("p_a"))
        seen = checkpointed(first.select("s", F.col("py").alias("node"), F.col("p_b").alias("b")))
        while True:  # a round adds what one more relation leads to
            clock = seen.groupBy("s").agg(F.min("b").alias("since"))
            out = core.join(clock, "s").join(seen.select("s", F.col("node").alias("x"), F.lit(True).alias("__at")), ["s", "x"], "left")
            new = out.where(F.coalesce("__at", F.lit(False)) | F.coalesce(F.col("x_a") > F.col("since"), F.lit(False))).select("s", F.col("y").alias("node"), F.col("y_b").alias("b"))
            more = checkpointed(seen.unionByName(new).distinct())
            grown = more.count() > seen.count()
            seen = more
            if not grown:
                break
        clock = seen.groupBy("s").agg(F.min("b").alias("since"), F.collect_set("node").alias("nodes"))
        closed = first.join(start, "s").join(clock, "s").where(F.array_contains("nodes", F.col("px")) | F.coalesce(F.col("p_a") > F.col("since"), F.lit(False)))
        gone = checkpointed(gone.unionByName(closed.select("s", F.col("px").alias("x"), F.col("py").alias("y"))))
        rest = core.join(first.select("s", F.col("px").alias("x"), F.col("py").alias("y")), ["s", "x", "y"], "left_anti").select(*core.columns)
        core = _on_cycles(rest)
    return gone


def _contradicting(edges: list[tuple]) -> list[tuple[int, int]]:
    """What ``dropped_relations`` drops of the edges (x, y, x_a, y_b) of one story, of which none is against the clock."""
    left: dict[int, set[int]] = {}
    end, begin = {}, {}
    for x, y, x_a, y_b in edges:
        left.setdefault(x, set()).add(y)
        begin[x], end[y] = x_a, y_b
    late = sorted((x for x in left if begin[x] is not None), key=lambda x: -begin[x])
    dropped = []
    for x, y in sorted((e[0], e[1]) for e in edges):
        seen, todo, since, i = {y}, [y], None, 0
        while todo:
            node = todo.pop()
            onward = set(left.get(node, ()))
            if end[node] is not None and (since is None or end[node] < since):
                since = end[node]
            while since is not None and i < len(late) and begin[late[i]] > since:
                onward |= left[late[i]]
                i += 1
            todo += onward - seen
            seen |= onward
        if x in seen or (since is not None and begin[x] is not None and begin[x] > since):
            dropped.append((x, y))
        left[x].discard(y)
    return dropped


def _settled(events: list[tuple], edges: list[tuple[int, int]]) -> dict[int, int]:
    """The tiers of the events (k, a, b) of one story: sweeps by the clock and steps along the edges in turns until nothing moves."""
    least = {k: 0 for k, _, _ in events}
    order = sorted([(a, 0, k) for k, a, _ in events if a is not None] + [(b, 1, k) for k, a, b in events if a is not None])
    while True:
        tier, ended = dict(least), 0
        for _, is_end, k in order:
            if is_end:
                ended = max(ended, tier[k] + 1)
            else:
                tier[k] = max(ended, least[k])
        least = dict(tier)
        for x, y in edges:
            least[y] = max(least[y], tier[x] + 1)
        if least == tier:
            return tier


def _dropped_in_tasks(edges: DataFrame) -> DataFrame:
    """``dropped_relations`` story by story."""

    def run(story: pa.Table) -> pa.Table:
        rows = list(zip(*(story[c].to_pylist() for c in ("x", "y", "x_a", "y_b"))))
        against = [(x, y) for x, y, x_a, y_b in rows if x_a is not None and y_b is not None and y_b < x_a]
        out = against + _contradicting([r for r in rows if r[:2] not in set(against)])
        x, y = zip(*out) if out else ((), ())
        return pa.table({"s": pa.array([story["s"][0].as_py()] * len(out), pa.int64()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return edges.groupBy("s").applyInArrow(run, "s long, x long, y long")


def _tiers_in_tasks(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """(s, k, tier) story by story."""

    def run(events: pa.Table, edges: pa.Table) -> pa.Table:
        found = _settled(list(zip(*(events[c].to_pylist() for c in "kab"))), list(zip(edges["x"].to_pylist(), edges["y"].to_pylist())))
        story = [events["s"][0].as_py()] * len(found) if found else []
        return pa.table({"s": pa.array(story, pa.int64()), "k": pa.array(list(found), pa.int64()), "tier": pa.array(list(found.values()), pa.int64())})

    return spans.groupBy("s").cogroup(kept.groupBy("s")).applyInArrow(run, "s long, k long, tier long")


def _sweep(rows: DataFrame) -> DataFrame:
    """(s, k, tier) of dated events (s, k, a, b, least): the greatest of ``least`` and of one more than what has ended before.

    The starts and ends of a story come in order; what is held are the events under way.
    """
    starts = rows.select("s", F.col("a").alias("at"), F.lit(0).alias("is_end"), "k", "least")
    ends = rows.select("s", F.col("b").alias("at"), F.lit(1).alias("is_end"), "k", "least")
    # by a hash of the story: Spark leaves a repartition by "s" out where it takes the union for dealt by it already
    ordered = starts.unionByName(ends).repartition(F.xxhash64("s")).sortWithinPartitions("s", "at", "is_end", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        story, ended, under_way = None, 0, {}
        for batch in batches:
            found = []
            for s, _, is_end, k, least in zip(*(c.to_pylist() for c in batch.columns)):
                if s != story:
                    story, ended, under_way = s, 0, {}
                if is_end:
                    ended = max(ended, under_way.pop(k) + 1)
                else:
                    under_way[k] = max(ended, least)
                    found.append((s, k, under_way[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["s", "k", "tier"])

    return ordered.mapInArrow(run, "s long, k long, tier long")


def _tiers_in_rounds(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """(s, k, tier) of all stories at once, a round for each relation on the longest chain."""
    floor = spans.withColumn("least", F.lit(0).cast("long"))
    while True:
        tiers = checkpointed(_sweep(floor.where("a IS NOT NULL").select("s", "k", "a", "b", "least")).unionByName(floor.where("a IS NULL").select("s", "k", F.col("least").alias("tier"))))
        need = kept.join(tiers.select("s", F.col("k").alias("x"), "tier"), ["s", "x"]).groupBy("s", F.col("y").alias("k")).agg((F.max("tier") + 1).alias("need"))
        raised = tiers.join(need, ["s", "k"], "left").select("s", "k", F.greatest("tier", F.coalesce("need", F.lit(0))).alias("least"), (F.coalesce("need", F.lit(0)) > F.col("tier")).alias("moved"))
        raised = checkpointed(raised)
        if raised.where("moved").isEmpty():
            return tiers
        floor = spans.join(raised.select("s", "k", "least"), ["s", "k"])


def ordered_timeline(events: DataFrame, relations: DataFrame, story: str = "story_id", key: str = "canonical_id", start: str = "t_start", end: str = "t_end", earlier: str = "earlier", later: str = "later", in_task: int = IN_TASK) -> tuple[DataFrame, DataFrame]:
    """``((story, key, tier), (story, earlier, later))``: tiers, and the relations dropped because they contradict the rest.

    The tier of an event is the longest chain before it, by the clock and by relations: sweeps by the clock and steps along relations take turns until
    nothing moves, one turn for each relation on the longest chain.  A dated event that nothing orders takes the tier of the ordered dated event whose middle
    is nearest (the earlier on a tie); one that has neither a time nor a relation has no tier (null).  Events are named once; repeated rows of
    an event count as its whole span; relations to unknown events, to itself or with nulls are ignored.
    """
    raw = _spans(events, story, key, start, end).where("s IS NOT NULL AND k IS NOT NULL")
    spans = checkpointed(raw.groupBy("s", "k").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    edges = checkpointed(relation_edges(spans, relations, story, earlier, later))
    size = spans.groupBy("s").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    large = checkpointed(size.where(F.col("n") > in_task).select("s").distinct())
    of = lambda df, how: df.join(large, "s", how)
    gone = _dropped_in_tasks(of(edges, "left_anti"))
    some = not large.isEmpty()
    gone = checkpointed(gone.unionByName(dropped_relations(of(edges, "left_semi"))) if some else gone)
    kept = checkpointed(edges.join(gone, ["s", "x", "y"], "left_anti").select("s", "x", "y"))
    tiers = _tiers_in_tasks(of(spans, "left_anti"), of(kept, "left_anti"))
    tiers = checkpointed(tiers.unionByName(_tiers_in_rounds(of(spans, "left_semi"), of(kept, "left_semi"))) if some else tiers)
    far = spans.groupBy("s").agg(F.max("a").alias("last_start"), F.min("b").alias("first_end"))
    related = kept.select("s", F.col("x").alias("k")).unionByName(kept.select("s", F.col("y").alias("k"))).distinct().withColumn("__rel", F.lit(True))
    placed = spans.join(tiers, ["s", "k"]).join(far, "s").join(related, ["s", "k"], "left")
    by_clock = F.coalesce(F.col("b") < F.col("last_start"), F.lit(False)) | F.coalesce(F.col("first_end") < F.col("a"), F.lit(False))
    placed = checkpointed(placed.select("s", "k", "a", "tier", F.timestamp_micros(((F.col("a") + F.col("b")) / 2).cast("long")).alias("middle"), (by_clock | F.coalesce("__rel", F.lit(False))).alias("ordered")))
    alone = placed.where("NOT ordered AND a IS NOT NULL")
    near = nearest_in_time(alone, placed.where("ordered AND a IS NOT NULL"), "s", "k", "middle", "tier")
    lonely = alone.select("s", "k", F.col("tier").alias("own")).join(near.withColumnRenamed("tier", "near"), ["s", "k"], "left").select("s", "k", F.coalesce("near", "own").alias("tier"))
    undated = placed.where("NOT ordered AND a IS NULL").select("s", "k", F.lit(None).cast("long").alias("tier"))
    all_ = placed.where("ordered").select("s", "k", "tier").unionByName(lonely).unionByName(undated)
    return all_.select(F.col("s").alias(story), F.col("k").alias(key), "tier"), gone.select(F.col("s").alias(story), F.col("x").alias(earlier), F.col("y").alias(later))
