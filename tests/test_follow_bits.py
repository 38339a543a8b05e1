"""Reasons of a match travel as a number."""

from attestor.plans.catalog import QUERIES


def test_reasons_are_no_sets_of_strings(spark):
    plan = QUERIES["follow_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(kind" not in plan and "bit_or(" in plan
