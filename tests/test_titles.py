"""Titles, roles and names: restated cases over a small registry."""

from pyspark.sql import functions as F

from attestor.operators import titles as T

REGISTRY = [
    (1, "cji", "CJI", "sc_judge", None),
    (2, "cji", "Chief Justice of India", "sc_judge", None),
    (3, "cji", "Chief Justice", "sc_judge", ["Supreme Court", "India"]),
    (4, "sc_judge", "Supreme Court judge", "judge", None),
    (5, "judge", "judge", None, None),
    (6, "cm", "Chief Minister", "minister", None),
    (7, "minister", "Minister", None, None),
]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "place int, role string, form string, is_a string, needs array<string>")


def test_roles_and_kinds(spark):
    pairs = [("CJI", "Chief Justice of India", ""), ("CJI", "Supreme Court judge", "Supreme Court"), ("Supreme Court judge", "C.J.I.", None), ("CJI", "Chief Minister", ""), ("Chief  Justice", "CJI", "The Supreme Court heard"), ("Chief Justice", "CJI", "Kerala"), ("CJI", "judge", ""), ("nobody", None, "")]
    got = {(r.a, r.b): r.relation for r in T.title_relations(spark.createDataFrame(pairs, "a string, b string, context string"), registry(spark)).collect()}
    assert [got[a, b] for a, b, _ in pairs] == ["same", "a_is_b", "b_is_a", None, "same", None, "a_is_b", None]
    assert T.title_relations(spark.createDataFrame([], "a string, b string, context string"), registry(spark)).count() == 0


def test_titles_before_names_and_names_without_them(spark):
    words, evidence = T.title_words(registry(spark), ["Mr", "Dr"], ["Union", "Chief", "Air"])
    cases = [
        ("Assam Chief Minister Himanta Biswa Sarma said", "Himanta Biswa Sarma", "Assam Chief Minister"),
        ("It rained on Monday. Supreme Court judge Ujjal Bhuyan said", "Ujjal Bhuyan", "Supreme Court judge"),
        ("The Commission for Air Quality Management Kumar said", "Kumar", ""),
        ("While the Chief Justice of India Rao spoke", "Rao", "Chief Justice of India"),
        ("On Friday Dr Rao-Singh left", "Rao", ""),
        ("Minister. Rao left", "Rao", "Minister."),
        ("Rao left", "Rao", ""),
        ("then Union Rao left", "Rao", ""),
        (None, "Rao", ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, name string, want string")
    rows = df.withColumn("got", T.title_before(F.col("text"), F.col("name"), words, evidence)).collect()
    assert [(r.text, r.got) for r in rows if r.got != r.want] == []
    names = [("Assam Chief Minister Himanta Biswa Sarma", "Himanta Biswa Sarma"), ("Ujjal Bhuyan", "Ujjal Bhuyan"), ("Chief Minister", "Chief Minister"), ("Mr  Rao", "Rao"), ("", ""), (None, "")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, name string, want string")
    rows = df.withColumn("got", T.strip_title(F.col("name"), words)).collect()
    assert [(r.name, r.got) for r in rows if r.got != r.want] == []
