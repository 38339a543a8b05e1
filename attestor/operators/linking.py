"""Joins: near copies, owners, intervals, nearest times, follows, threads, vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions.text import hashed_shingles, words
from attestor.operators import intake as I
from attestor.operators.graph import connected_components
from attestor.plans.durable import checkpointed, durable, small


def shingle_chains(docs: DataFrame, key: str, text: str, at: str, hours: int = 72, k: int = 5, most: int = 4_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the same shingles, as ``(sets, chains, members)``.

    ``sets`` is (set, sh): each distinct set of hashed shingles once.  A chain is a run of rows of one set, none more than ``hours``
    after the one before: ``chains`` is (set, chain, first_at, last_at), named by its first row, and ``members`` is (key, set, chain).
    Rows without a time stand alone.  Shingles are worked out once and written down; a set is that of its first row, so they are not shuffled while the rows (a number each) of at
    most ``most`` sets can be sent to all.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(at).alias("at"), words(F.coalesce(F.col(text), F.lit(""))).alias("__t")).select("id", "at", hashed_shingles(F.col("__t"), k).alias("sh"))
    rows = durable(rows.withColumn("set", F.struct(F.xxhash64("sh").alias("x"), F.xxhash64(F.lit(k), "sh").alias("y"))).withColumn("row", F.monotonically_increasing_id()), "shingles")
    first = rows.groupBy("set").agg(F.min("row").alias("row")).select("row")
    few = first.limit(most + 1).count() <= most
    sets = rows.join(F.broadcast(first) if few else first, "row", "left_semi").select("set", "sh")
    sets = sets if few else durable(sets, "sets")
    order = W.partitionBy("set").orderBy("at", "id")
    begins = F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) > hours * 3600 * 1_000_000, F.lit(True))
    head = F.max(F.when(F.col("begins"), F.struct("at", "id"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    members = durable(rows.drop("sh", "row").withColumn("begins", begins).withColumn("chain", head["id"]).select("id", "at", "set", "chain"), "members")
    chains = members.groupBy("set", "chain").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return sets, chains, members.select(F.col("id").alias(key), "set", "chain")


def near_sets(sets: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``(a, b, similarity)`` in both directions for distinct shingle sets with Jaccard at the threshold or above.

    Exact, by prefix filtering: with the shingles of each set in ascending order of
    their frequency, two sets that reach the threshold share a shingle among the
    first |s| - ceil(t |s|) + 1 of each.  So frequent shingles (a notice in a third of
    all texts) make no candidates.  All shingles are shuffled once, under the first half of their set's name; only those of several sets go on,
    and only sets that are asked for are looked up.
    """
    each = sets.select(F.col("set.x").alias("x"), F.size("sh").alias("size"), F.explode("sh").alias("s"))
    shared = durable(each.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("s"))).where("df > 1"), "shared")
    # shingles of a single set come first in the order and take up places of the prefix
    of = W.partitionBy("x")
    place = F.row_number().over(of.orderBy("df", "s")) + F.col("size") - F.count(F.lit(1)).over(of)
    p = durable(shared.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1).select("x", "size", "s"), "prefixes")
    q = p.select(F.col("x").alias("other"), F.col("size").alias("other_size"), "s")
    cand = durable(p.join(q, "s").where((F.col("x") < F.col("other")) & (F.least("size", "other_size") >= F.lit(threshold) * F.greatest("size", "other_size"))).select("x", "other").distinct(), "candidates")
    asked = small(cand.select("x").union(cand.select("other")).distinct())
    named = durable(sets.select(F.col("set.x").alias("x"), "set", "sh").join(asked, "x", "left_semi"), "asked")
    both = cand.join(named.withColumnRenamed("sh", "u"), "x").join(named.select(F.col("x").alias("other"), F.col("set").alias("two"), F.col("sh").alias("v")), "other")
    common = F.size(F.array_intersect("u", "v"))
    found = both.select("set", F.col("two").alias("other"), (common / (F.size("u") + F.size("v") - common)).alias("similarity"))
    found = durable(found.where(F.col("similarity") >= threshold), "near")
    return found.select(F.col("set").alias("a"), F.col("other").alias("b"), "similarity").unionByName(found.select(F.col("other").alias("a"), F.col("set").alias("b"), "similarity"))


def _near_chains(chains: DataFrame, near: DataFrame, hours: int) -> DataFrame:
    """``(chain, other, similarity, ...)``: chains of similar sets that come within ``hours`` of each other."""
    one = chains.select(F.col("set").alias("a"), "chain", "first_at", "last_at")
    two = chains.select(F.col("set").alias("b"), F.col("chain").alias("other"), F.col("first_at").alias("other_first"), F.col("last_at").alias("other_last"))
    reach = F.expr(f"INTERVAL {hours} HOURS")
    return near.join(one, "a").join(two, "b").where((F.col("other_first") <= F.col("last_at") + reach) & (F.col("other_last") >= F.col("first_at") - reach))


def near_dup_classes(docs: DataFrame, key: str = "article_id", text: str = "text", at: str = "published_at", threshold: float = 0.45, hours: int = 72) -> DataFrame:
    """``(key, class_id, copies, n_links)`` for every row.

    A class is a chain of rows with the same shingles, each within ``hours`` of the next, named by its first row; ``copies`` are its rows and
    ``n_links`` the classes of other texts at the threshold or above that come within ``hours`` of it.
    """
    sets, chains, members = shingle_chains(docs, key, text, at, hours)
    chains = durable(chains, "chains")
    links = _near_chains(chains, near_sets(sets, threshold), hours).groupBy("chain").agg(F.count(F.lit(1)).alias("n_links"))
    per = chains.select("chain", "n").join(links, "chain", "left")
    return members.join(per, "chain").select(key, F.col("chain").alias("class_id"), F.col("n").alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def wire_groups(docs: DataFrame, key: str = "article_id", text: str = "text", at: str = "published_at", threshold: float = 0.45, hours: int = 72) -> DataFrame:
    """``(key, wire_group)`` for every row: it joins the group of its most similar earlier row within ``hours``, the earliest on a tie, or founds its own.

    A copy follows the copy before it, so the parent is sought once for each chain of copies, among the chains that are
    under way in the ``hours`` before its first row; the root of the parents names the group.
    """
    sets, chains, members = shingle_chains(docs, key, text, at, hours)
    chains = durable(chains, "chains")
    found = _near_chains(chains, near_sets(sets, threshold), hours)
    earlier = found.where(((F.col("other_first") < F.col("first_at")) | ((F.col("other_first") == F.col("first_at")) & (F.col("other") < F.col("chain")))) & (F.col("other_last") >= F.col("first_at") - F.expr(f"INTERVAL {hours} HOURS")))
    best = earlier.groupBy("chain").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "other_first", "other")).alias("best"))
    roots = chain_roots(chains.select("chain").join(best.select("chain", F.col("best.other").alias("parent")), "chain", "left"), "chain", "parent")
    return members.join(roots, "chain").select(key, F.col("root").alias("wire_group"))


def chain_roots(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, root)``: the end of every parent chain, by pointer doubling, until nothing moves: n hops take log2(n) rounds.

    Nodes of a cycle never end; what still moves after as many rounds as the longest chain could take has no root (null).
    """
    p = checkpointed(parents.select(F.col(node).alias("n"), F.coalesce(F.col(parent), F.col(node)).alias("p")))
    for _ in range(p.count().bit_length() + 1):
        up = p.select(F.col("n").alias("p"), F.col("p").alias("g"))
        q = checkpointed(p.join(up, "p", "left").select("n", F.coalesce("g", "p").alias("q"), (F.coalesce("g", "p") != F.col("p")).alias("moved")))
        p = q.select("n", F.col("q").alias("p"))
        if q.where("moved").isEmpty():
            return p.select(F.col("n").alias(node), F.col("p").alias("root"))
    up = p.select(F.col("n").alias("p"), F.col("p").alias("g"))
    return p.join(up, "p", "left").select(F.col("n").alias(node), F.when(F.col("g") == F.col("p"), F.col("p")).alias("root"))


def owner_resolve(rows: DataFrame, owners: DataFrame, name: str, host: Column) -> DataFrame:
    """Owner by exact name, else by normalised name, else by the longest domain suffix, else the name itself."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"^the |[^a-z0-9]", "")
    by_name = owners.select(F.col("name").alias("__n1"), F.col("owner").alias("__o1"))
    by_plain = owners.groupBy(plain(F.col("name")).alias("__n2")).agg(F.min("owner").alias("__o2"))
    x = rows.join(small(by_name), F.col(name) == F.col("__n1"), "left").join(small(by_plain), plain(F.col(name)) == F.col("__n2"), "left").withColumn("__host", host)
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    doms = owners.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("owner").alias("__o3"))
    hit = x.select("__host").distinct().withColumn("domain", F.explode(suffixes)).join(small(doms), "domain").groupBy("__host").agg(F.max_by("__o3", F.length("domain")).alias("__o3"))
    return x.join(hit, "__host", "left").withColumn("owner", F.coalesce("__o1", "__o2", "__o3", F.col(name))).drop("__n1", "__o1", "__n2", "__o2", "__o3", "__host")


def before_pairs(rows: DataFrame, group: str, key: str, start: str = "t_start", end: str = "t_end", most: int = 10_000_000) -> DataFrame:
    """Range self-join in each group: a ends before b starts.

    The pairs grow with the square of a group, so the join is dealt by them and not by the rows that come in: they are bounded by counts first, and a task gets about
    ``most`` of them.  Rows are shuffled once and read as both sides, packed so that both ask for the same; only groups of ten times ``most`` pairs and more are cut
    into strips, of which two meet under one number (below zero where they are one strip).
    """
    types = dict(rows.dtypes)
    whole = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if types[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("long")
    known = rows.where(F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("__n")).withColumn("__strips", F.ceil(F.col("__n") / math.isqrt(10 * most)).cast("int"))
    total = sizes.agg(F.sum(F.col("__n") * F.col("__n"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // most) + 1)
    large = durable(sizes.where("__strips > 1").select(group, "__strips"), "large-groups")
    parts = known.join(small(large), group, "left").withColumn("__strips", F.coalesce("__strips", F.lit(1))).withColumn("__own", F.pmod(F.xxhash64(key), "__strips").cast("int"))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    tile = F.when(low == high, -1 - low).otherwise(low * F.col("__strips") + high)
    packed = parts.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__strips") - 1))).select(group, tile.alias("__tile"), F.array(whole(key), whole(start), whole(end), F.col("__own").cast("long")).alias("__a"))
    x = packed.repartition(n, group, "__tile").hint("merge")
    met = x.join(x.withColumnRenamed("__a", "__b"), [group, "__tile"])
    a, b = F.col("__a"), F.col("__b")
    return met.where(((F.col("__tile") < 0) | (a[3] != b[3])) & (a[2] < b[1])).select(group, a[0].cast(types[key]).alias("a"), b[0].cast(types[key]).alias("b"))


def nearest_in_time(left: DataFrame, right: DataFrame, group: str, key: str, at: str, value: str) -> DataFrame:
    """As-of nearest: the value of the row of ``right`` in the group closest in time (the earlier, then the least value, on a tie).

    Both sides meet in one sorted window, so the join emits no pairs.
    """
    w = W.partitionBy(group).orderBy("__at", "__right", "__v")
    rows = left.select(group, F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__right")).unionByName(
        right.select(group, F.lit(None).cast(dict(left.dtypes)[key]).alias("__k"), F.col(at).alias("__at"), F.col(value).alias("__v"), F.lit(0).alias("__right"))
    )
    item = F.when(F.col("__right") == 0, F.struct(F.col("__at").alias("at"), F.col("__v").alias("v")))
    prev = F.last(item, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    nxt = F.first(item, True).over(w.rowsBetween(0, W.unboundedFollowing))
    gap = lambda x: F.abs(F.unix_micros(F.col("__at")) - F.unix_micros(x["at"]))
    both = rows.withColumn("__p", prev).withColumn("__n", nxt).where("__right = 1")
    pick = F.when(F.col("__p").isNull() | (gap(F.col("__n")) < gap(F.col("__p"))), F.col("__n.v")).otherwise(F.col("__p.v"))
    return both.select(group, F.col("__k").alias(key), pick.alias(value))


def cosine_topk(queries: DataFrame, base: DataFrame, key: str = "article_id", vector: str = "embedding", k: int = 40, block_rows: int = 4096) -> DataFrame:
    """The k most similar rows of ``base`` for every query, exact, by blocks.

    Both sides are dealt to blocks of about ``block_rows`` rows, counted first, and every pair of
    blocks meets: it is one matrix product in an Arrow task and leaves its own top k, which
    a window then merges.  So a task holds two blocks at any size of the tables.
    """
    n_q, n_b = (max(1, -(-df.count() // block_rows)) for df in (queries, base))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    q = queries.select(F.lit(1).alias("side"), F.col(key).alias("id"), F.col(vector).alias("v"), dealt(n_q).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    b = base.select(F.lit(0).alias("side"), F.col(key).alias("id"), F.col(vector).alias("v"), dealt(n_b).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    rows = q.select("side", "id", "v", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).unionByName(b.select("side", "id", "v", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf.side == 1], pdf[pdf.side == 0]
        if one.empty or two.empty:
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        x, y = (np.stack(p.v.to_numpy()).astype(np.float64) for p in (one, two))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        s = x @ y.T
        s[one.id.to_numpy()[:, None] == two.id.to_numpy()[None, :]] = -2
        n = min(k, s.shape[1])
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        out = pd.DataFrame({"id": np.repeat(one.id.to_numpy(), n), "other": two.id.to_numpy()[best].ravel(), "cosine": np.take_along_axis(s, best, 1).ravel()})
        return out[out.cosine > -2]

    near = rows.groupBy("i", "j").applyInPandas(block, "id long, other long, cosine double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(key), "other", "cosine", "rank")


def held_without_home(titles: DataFrame, key: str, home: str, terms: str) -> DataFrame:
    """Keys of rows outside (``home`` false) that share no two terms with any one row at home; rows with a null ``home`` take no part.

    Two rows share two terms if they share a pair of terms, so rows meet by pairs, each of which the home rows hold once: no pairs of rows arise.
    ``terms`` is a short list of distinct terms; n of them make n (n - 1) / 2 pairs.
    """
    t = F.array_sort(terms)
    after = lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    pairs = titles.select(F.col(key).alias("k"), F.col(home).alias("h"), t.alias("t")).where("size(t) >= 2").select("k", "h", F.explode(F.flatten(F.transform("t", after))).alias("p")).select("k", "h", "p.x", "p.y")
    met = pairs.where("NOT h").select("k", "x", "y").join(pairs.where("h").select("x", "y").distinct(), ["x", "y"], "left_semi").select(F.col("k").alias(key)).distinct()
    return titles.where(~F.col(home)).select(key).join(met, key, "left_anti")


def held_at_gate(rows: DataFrame, key: str, home: str, owner: str, at: str, names: str, told: str, hours: int = 48, most: int = 3) -> DataFrame:
    """Keys of rows outside (``home`` false) that the gate holds; rows with a null ``home`` take no part.

    A row passes if ``told`` (its text mentions home), if it shares two names with one home row, or if it shares two names each with rows outside of two other owners;
    only rows count that come within ``hours`` of it, so they are fresh in one run.  Rows meet by pairs of names and by cells of ``hours``, and no pairs of rows arise: a pair of names keeps
    for each cell and owner its first and last time, and of the owners the ``most`` that come first and last.  Of three owners two are others, so that decides.
    """
    span = hours * 3600 * 1_000_000
    after = lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    dated = rows.select(F.col(key).alias("k"), F.col(home).alias("h"), F.col(owner).alias("o"), F.unix_micros(at).alias("at"), F.array_sort(names).alias("t")).where("size(t) >= 2")
    pairs = dated.select("k", "h", "o", "at", F.floor(F.col("at") / span).alias("cell"), F.explode(F.flatten(F.transform("t", after))).alias("p")).select("k", "h", "o", "at", "cell", "p.x", "p.y")
    pairs = durable(pairs.where("h IS NOT NULL AND at IS NOT NULL"), "name-pairs")
    bounds = lambda df, *by: df.groupBy("x", "y", "cell", *by).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    around = lambda df: df.withColumn("off", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("cell", F.col("cell") + F.col("off"))
    near = (F.col("off") == 0) | ((F.col("off") == 1) & (F.col("last") >= F.col("at") - span)) | ((F.col("off") == -1) & (F.col("first") <= F.col("at") + span))
    outside = pairs.where("NOT h")
    covered = outside.select("k", "at", "cell", "x", "y").join(around(bounds(pairs.where("h"))), ["x", "y", "cell"]).where(near).select("k").distinct()
    told_by = bounds(outside.where("o IS NOT NULL"), "o")
    cell = ["x", "y", "cell"]
    ends = I.cap_per_group(told_by, cell, [F.col("first"), F.col("o")], most).unionByName(I.cap_per_group(told_by, cell, [F.desc("last"), F.col("o")], most)).drop("rank").distinct().withColumnRenamed("o", "other")
    others = outside.select("k", "o", "at", *cell).join(around(ends), cell).where(near & (F.col("o") != F.col("other"))).select("k", "other").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    passed = covered.unionByName(others.select("k")).select(F.col("k").alias(key)).distinct()
    return rows.where(~F.col(home) & ~F.col(told)).select(key).join(passed, key, "left_anti")


def parents_by_terms(rows: DataFrame, key: str, terms: str, least: int = 3, most: int = 6) -> DataFrame:
    """``(child, parent, shared)``: of the rows with a smaller key that share at least ``least`` terms, the ``most`` that share most, smaller keys first on a tie.

    Exact without pairs of rows.  Let a parent share exactly the set S with a child.  All rows before it that hold S share as much or more, so a parent among the first
    ``most`` is one of the ``most`` least keys that hold S.  Each set of terms keeps these; a child looks up all sets of its own and takes the largest through which it meets a parent.
    ``terms`` is a short list of distinct terms (a title of 80 letters holds ten of seven letters): n of them make up to 2^n sets.  Rows with equal terms ask once.
    """
    each = rows.select(F.col(key).alias("k"), F.array_sort(terms).alias("t")).where(F.size("t") >= least)
    each = durable(each.select("k", "t", F.struct(F.xxhash64("t").alias("x"), F.xxhash64(F.lit(1), "t").alias("y")).alias("c")), "terms")
    first = I.cap_per_group(each.select("k", "c"), ["c"], [F.col("k")], most).select("k", "c")
    kinds = each.groupBy("c").agg(F.first("t").alias("t"))
    grown = F.aggregate("t", F.array(F.array().cast("array<string>")), lambda sets, w: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, w))))
    sets = kinds.select("c", F.explode(F.filter(grown, lambda s: F.size(s) >= least)).alias("s")).select("c", F.size("s").alias("n"), F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y"))
    sets = durable(sets, "term-sets")
    holders = I.cap_per_group(sets.join(first, "c").select("x", "y", "k"), ["x", "y"], [F.col("k")], most).select("x", "y", "k")
    lists = holders.groupBy("x", "y").agg(F.collect_list("k").alias("ks"))
    met = sets.join(lists, ["x", "y"]).select("c", "n", F.explode("ks").alias("parent")).groupBy("c", "parent").agg(F.max("n").alias("n"))
    ranked = I.cap_per_group(met, ["c", "n"], [F.col("parent")], most).groupBy("c").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "parent"))).alias("found"))
    best = F.slice(F.filter("found", lambda f: f["parent"] < F.col("k")), 1, most)
    return each.select("k", "c").join(ranked, "c").select(F.col("k").alias("child"), F.explode(best).alias("f")).select("child", "f.parent", (-F.col("f.less")).cast("long").alias("shared"))


def parents_by_names(rows: DataFrame, key: str, words: str, names: str, daughters: DataFrame, least: int = 3, most: int = 6, strip: int = 10_000, block: int = 2000) -> DataFrame:
    """``(child, parent, shared)``: of the rows with a smaller key that share a name and at least ``least`` words, the ``most`` that share most words, smaller keys first on a tie.

    ``daughters`` (child, parent) are never parents of their parent.  Rows meet under each name they share, words are counted there, and every name leaves a child its first ``most``,
    of which the first over all its names are kept.  Rows of a name are dealt into strips, and two strips meet in one task, which compares them block by block: no pair that is
    not among the first leaves a task.  Rare names share a task.
    """
    own = daughters.groupBy(F.col("parent").alias("k")).agg(F.collect_set("child").alias("barred"))
    each = rows.select(F.col(key).alias("k"), F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)).alias("w"), F.array_distinct(names).alias("names")).where(F.size("w") >= least)
    each = each.join(own, "k", "left").select("k", "w", F.coalesce("barred", F.array().cast("array<long>")).alias("barred"), F.explode("names").alias("name")).withColumn("name", F.xxhash64("name"))
    sizes = durable(each.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("strips", F.ceil(F.col("n") / strip).cast("int")), "names")
    held = sizes.agg(F.sum("n")).first()[0] or 0
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // 20_000)
    dealt = each.join(small(sizes.select("name", "strips")), "name").withColumn("own", F.pmod(F.xxhash64("k"), "strips").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    tiles = dealt.select(F.when(F.col("strips") == 1, F.pmod("name", F.lit(groups))).otherwise(F.col("name")).alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name", "own", "k", "w", "barred")

    def few(k: list, w: list, barred: list) -> list[tuple]:
        told = sorted(zip(k, map(set, w), map(set, barred)), key=lambda r: r[0])
        out = []
        for at, (child, mine, mine_barred) in enumerate(told):
            met = sorted((-n, p) for p, its, _ in told[:at] if p < child and (n := len(mine & its)) >= least and p not in mine_barred)
            out += [(child, p, -n) for n, p in met[:most]]
        return out

    def firsts(k: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray, barred: dict) -> list[tuple]:
        """For each row of ``x`` the first of ``y`` (by ascending key) that may be its parents."""
        score = np.where((shared >= least) & (k[y][None, :] < k[x][:, None]), shared.astype(np.int64) * len(y) + np.arange(len(y))[::-1], -1)
        for at in np.flatnonzero(np.isin(k[x], list(barred))) if barred else ():
            score[at, np.isin(k[y], barred[k[x[at]]])] = -1
        n = min(most, len(y))
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        row, col = np.nonzero(np.take_along_axis(score, best, 1) >= 0)
        col = best[row, col]
        return list(zip(k[x[row]].tolist(), k[y[col]].tolist(), shared[row, col].tolist()))

    def many(k: np.ndarray, w: list, barred: dict, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple]]:
        def held_by(at: np.ndarray) -> dict:
            lists = [w[r] for r in at]
            place, word = np.repeat(np.arange(len(at)), [len(x) for x in lists]), np.concatenate(lists)
            order = np.argsort(word, kind="stable")
            known, begin = np.unique(word[order], return_index=True)
            return dict(zip(known.tolist(), np.split(place[order], begin[1:])))

        for left, right in pairs:
            parts = lambda at: [at[lo : lo + block] for lo in range(0, len(at), block)]
            ys = [(y, held_by(y)) for y in parts(right)]
            for n, x in enumerate(parts(left)):
                mine = held_by(x)
                for y, its in ys[n:] if left is right else ys:
                    shared = np.zeros((len(x), len(y)), np.int32)
                    for word in mine.keys() & its.keys():
                        shared[np.ix_(mine[word], its[word])] += 1
                    yield firsts(k, x, y, shared, barred)
                    if x is not y:
                        yield firsts(k, y, x, np.ascontiguousarray(shared.T), barred)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("name", "ascending"), ("k", "ascending")]).combine_chunks()
        name, side, k = (table[c].to_numpy() for c in ("name", "own", "k"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        bounds = [*np.flatnonzero(np.diff(name, prepend=name[0] - 1)), len(name)]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            if hi - lo <= 24 and i == j:
                found = [few(part["k"].to_pylist(), part["w"].to_pylist(), part["barred"].to_pylist())]
            else:
                rows_of = lambda c: [x.values.to_numpy() for x in part[c]]
                barred = {key: x for key, x in zip(k[lo:hi].tolist(), rows_of("barred")) if len(x)}
                left = np.flatnonzero(side[lo:hi] == i)
                found = many(k[lo:hi], rows_of("w"), barred, [(left, left if i == j else np.flatnonzero(side[lo:hi] == j))])
            for some in found:
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], ["child", "parent", "shared"])

    met = tiles.groupBy("g", "i", "j").applyInArrow(compare, "child long, parent long, shared long").distinct()
    return I.cap_per_group(met, ["child"], [F.desc("shared"), F.col("parent")], most).select("child", "parent", "shared")


def shared_terms(one: DataFrame, two: DataFrame, a: str, b: str, terms: str = "terms", least: int = 2) -> DataFrame:
    """``(a, b, shared)``: pairs of rows of ``one`` and ``two`` that share at least two terms, with the number of terms they share.

    Rows meet by pairs of terms, and a pair of rows is told where the two least terms they share meet, so it arises
    once and nothing is gathered.  The join is dealt by the pairs it will give, counted first.
    """
    after = lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    paired = lambda df, k: df.select(F.col(k), F.array_sort(terms).alias("t")).where("size(t) >= 2").select(k, "t", F.explode(F.flatten(F.transform("t", after))).alias("p")).select(k, "t", "p.x", "p.y")
    x, y = paired(one, a), paired(two, b).withColumnRenamed("t", "u")
    total = x.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).join(y.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")), ["x", "y"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    n = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    both = x.repartition(n, "x", "y").hint("merge").join(y.repartition(n, "x", "y").hint("merge"), ["x", "y"]).withColumn("s", F.array_intersect("t", "u"))
    return both.where((F.col("s")[0] == F.col("x")) & (F.col("s")[1] == F.col("y"))).select(a, b, F.size("s").cast("long").alias("shared")).where(F.col("shared") >= least)


def pairs_of_shared_keys(one: DataFrame, two: DataFrame, a: str, b: str, keys: str = "keys", carried: tuple[str, ...] = (), most: int = 50_000_000) -> DataFrame:
    """``(a, b, shared, ...)``: pairs of rows of ``one`` and ``two`` that share a key, each once, with the keys (long) they share and the columns of ``one`` that are ``carried``.

    Rows meet by key and carry all their keys, so a pair is told at the least key it shares: pairs are never shuffled or gathered.  A key of more than ``most`` pairs is cut into
    strips on both sides, counted first.
    """
    x, y = (df.select(c, *also, F.col(keys).alias(u), F.explode(keys).alias("key")) for df, c, u, also in ((one, a, "u", carried), (two, b, "v", ())))
    sizes = durable(x.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(y.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key"), "key-sizes")
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    side, tasks = math.isqrt(most), max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // most) * 2 + 1)
    cut = small(sizes.where(F.col("n").cast("double") * F.col("m") > most).select("key", *[F.ceil(F.col(c) / side).cast("int").alias(p) for c, p in (("n", "p"), ("m", "q"))]))
    x, y = (df.join(cut, "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in "pq"}) for df in (x, y))
    strip = lambda c, parts: F.pmod(F.xxhash64(c), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    x = x.select(a, *carried, "u", "key", strip(a, "p").alias("i"), every("q").alias("j"))
    y = y.select(b, "v", "key", every("p").alias("i"), strip(b, "q").alias("j"))
    x, y = (df.repartition(tasks, "key", "i", "j").hint("merge") for df in (x, y))
    return x.join(y, ["key", "i", "j"]).select(a, b, *carried, "key", F.array_intersect("u", "v").alias("shared")).where(F.col("key") == F.array_min("shared")).drop("key")


def story_threads(links: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """The oldest ancestor of every child, over the least parent at each hop."""
    up = links.groupBy(child).agg(F.min(parent).alias("__p"))
    nodes = up.select(F.col(child).alias("n"), F.col("__p").alias("p")).unionByName(links.select(F.col(parent).alias("n"), F.lit(None).cast("long").alias("p")).join(up.select(F.col(child).alias("n")), "n", "left_anti").distinct())
    return chain_roots(nodes, "n", "p")


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """``(node, ancestor, hops)``: every ancestor of every node with the fewest hops to it, however deep the links go.

    Each round adds the pairs not known yet, so a cycle ends too (its nodes are ancestors of themselves).
    """
    step = checkpointed(links.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"))
    known = layer = checkpointed(step.withColumn("hops", F.lit(1)))
    hop = 1
    while not layer.isEmpty():
        hop += 1
        further = layer.join(up, "ancestor").select("node", F.col("__next").alias("ancestor")).distinct()
        layer = checkpointed(further.join(known, ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        known = checkpointed(known.unionByName(layer))
    return known
