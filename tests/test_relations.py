"""What two statements have to do with each other: restated cases, and what the fixture holds."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import relations as R
from attestor.plans.catalog import QUERIES

LINE = "The bridge over the river collapsed"
RELATED = [
    (LINE, "the bridge, over the river: collapsed!", "same"),
    (LINE, "Officials said the bridge over the river caved", "same"),
    ("12 people were wounded in the blast", "Twelve people were hurt in the explosion", "same"),
    ("26 people were killed in the blast", "twenty-six people were killed in the blast", "same"),
    ("26 people were killed in the blast", "forty people were killed in the blast", "different"),
    (LINE, "The bridge over the river never collapsed", "different"),
    ("Police said they held him", "Police denied they held him", "different"),
    ("He was arrested here in 2019", "He was arrested here in 2024", "different"),
    ("The vote is on 5 March here", "The vote is on March 6 here", "different"),
    ("The vote is on 5 March here", "The vote is on March 5th here", "b_covers_a"),
    ("The call was made on Thursday from Delhi", "The call was made from Delhi", "ask"),
    ("The bridge over the river collapsed under heavy rain near the market", LINE, "a_covers_b"),
    (LINE, "The bridge over the river collapsed under heavy rain near the market", "b_covers_a"),
    ("The bridge over the river collapsed again under heavy rain near the market", LINE, "ask_a_covers_b"),
    ("The bridge over the river collapsed with 12 people under heavy rain", LINE, "ask_a_covers_b"),
    ("Air Marshal Dixit met the crew of the ship", "Air Marshal Dixit praised the budget", "different"),
    ("Markets rose while traders slept", LINE, "different"),
    ("", "", "same"),
    (None, LINE, "different"),
]
DISPUTED = [
    ("26 people were killed in the blast", "twenty-six people were killed in the blast", None),
    ("26 people were killed in the blast", "forty people were killed in the blast", "number"),
    ("Police said 40 died in the train crash", "The family said 50 died in the train crash", "number"),
    ("Rs 5 crore was seized", "five crore rupees were seized", None),
    ("At least 40 people died in the crash", "50 people died in the crash", None),
    ("Up to 50 people died in the crash", "40 people died in the crash", None),
    ("17 of 19 crew members were rescued", "11 of 12 crew members were rescued", None),
    ("The march begins on Friday morning", "The march begins on Saturday morning", "date"),
    ("The mosque was razed on 6 December 1986", "The mosque was razed on December 6, 1987", "date"),
    ("The minister did resign from office", "The minister did not resign from office", "negation"),
    ("The minister resigned", "Rain fell in the hills", None),
    ("Rao said 40 died in the crash", "Khan was paid 50 for the crash", None),
    (None, None, None),
]


@pytest.mark.parametrize("table", ["relation", "dispute"])
def test_restated_cases(spark, table):
    cases = [(i, *c) for i, c in enumerate(RELATED if table == "relation" else DISPUTED)]
    df = spark.createDataFrame(cases, "i int, x string, y string, want string")
    text = (lambda c: F.col(c)) if table == "relation" else (lambda c: R.body(F.col(c)))
    rows = df.select("i", "x", "y", "want", R.profile(text("x")).alias("a"), R.profile(text("y")).alias("b"))
    rows = rows.withColumn("got", R.relation(F.col("a"), F.col("b")) if table == "relation" else R.dispute(F.col("a"), F.col("b")))
    wrong = [(r.x, r.y, r.want, r.got) for r in rows.collect() if r.got != r.want]
    assert not wrong


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_relation_and_dispute_occurs(spark, sf):
    found = {r.relation for r in QUERIES["relate_statements"](spark, f"/root/testdata/{sf}").select("relation").distinct().collect()}
    assert found == {"same", "a_covers_b", "b_covers_a", "ask", "ask_a_covers_b", "ask_b_covers_a", "different"}
    assert {"number", "negation"} <= {r.kind for r in QUERIES["dispute_candidate"](spark, f"/root/testdata/{sf}").select("kind").distinct().collect()}
