"""The views over the test tables keep the rules alive: several groups a story, every verdict and every kind of origin."""

import pytest
from pyspark.sql import functions as F

from attestor.plans.catalog import QUERIES


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stories_have_several_groups(spark, sf):
    groups = QUERIES["independence_groups"](spark, f"/root/testdata/{sf}").groupBy("story_id").agg(F.count_distinct("grp").alias("n"), F.count(F.lit(1)).alias("articles"))
    row = groups.agg(F.min("n").alias("least"), F.count_if(F.col("n") < F.col("articles")).alias("bound"), F.count(F.lit(1)).alias("stories")).first()
    assert row.least >= 3 and row.bound > 0.9 * row.stories


def test_every_verdict_and_origin_occurs(spark):
    path = "/root/testdata/sf0.01"
    assert {r.verdict for r in QUERIES["base_verdict"](spark, path).select("verdict").distinct().collect()} == {"disputed", "false", "developing", "corroborated", "confirmed", "unverified"}
    kinds = {r.k for r in QUERIES["origin_key"](spark, path).select(F.split("origin", ":")[0].alias("k")).distinct().collect()}
    assert {"pool", "agency", "gov", "own", "src"} <= kinds
