"""Shingles of a text are worked out once, and hashed as the runs of words they are."""

from pyspark.sql import functions as F

from attestor.functions.text import hashed_shingles, shingle_set
from attestor.operators import linking as L


def test_hashed_shingles_are_the_distinct_runs(spark):
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e f", "x " * 30 + "y", "b a c d e"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "t array<string>")
    got = df.select(hashed_shingles(F.col("t")).alias("h"), shingle_set(F.col("t")).alias("s")).collect()
    assert all(len(r.h) == len(set(r.h)) == len(r.s) and r.h == sorted(r.h) for r in got)
    named = {}
    for r in got:
        assert named.setdefault(tuple(r.h), sorted(r.s)) == sorted(r.s)
    assert len(named) == len(texts)


def test_sets_are_read_and_not_worked_out_again(spark):
    for most in (4_000_000, 1):
        docs = spark.createDataFrame([(i, f"one two three four five six w{i % 5}", i) for i in range(40)], "k long, text string, n long").withColumn("at", F.timestamp_seconds("n"))
        sets, chains, members = L.shingle_chains(docs, "k", "text", "at", most=most)
        assert sets.count() == 5 and chains.count() == 5 and members.count() == 40
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and "first(sh" not in plan
