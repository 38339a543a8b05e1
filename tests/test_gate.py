"""The gate of rows from outside against a plain version: mentions of home, two names of one home headline, two other owners, within 48 hours."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from attestor.operators import linking as L
from attestor.operators import names as N
from attestor.plans.catalog import ORACLE, QUERIES


def test_gate_is_that_of_a_plain_search(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([True, False, False, False, None]), rng.choice(["a", "b", "c", "d", "e", None]), start + dt.timedelta(minutes=rng.randrange(30_000)), [f"n{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(7))], rng.random() < 0.1) for i in range(500)]
    rows = [(*r[:4], sorted(set(r[4])), r[5]) for r in rows] + [(900, False, "a", start, ["p", "q"], False), (901, True, "b", start + dt.timedelta(hours=48), ["p", "q"], False), (902, True, "b", start + dt.timedelta(hours=48, seconds=1), ["p", "r"], False), (903, False, "a", start, ["p", "r"], False)]
    want = set()
    for k, h, o, at, names, told in rows:
        met = [r for r in rows if r[1] is not None and len(set(names) & set(r[4])) >= 2 and abs(at - r[3]) <= dt.timedelta(hours=48)]
        others = {r[2] for r in met if not r[1] and r[2] and o and r[2] != o}
        if h is False and not told and not any(r[1] for r in met) and len(others) < 2:
            want.add(k)
    df = spark.createDataFrame(rows, "k long, h boolean, o string, at timestamp, names array<string>, told boolean")
    got = [r.k for r in L.held_at_gate(df, "k", "h", "o", "at", "names", "told").collect()]
    assert set(got) == want and len(got) == len(want) and 900 not in want and 903 in want and any(r[1] is False and not r[5] and r[0] not in want for r in rows)


def test_names_of_headlines(spark):
    df = spark.createDataFrame([("Macron's talks with Jaishankar and The Wazirs",), ("जयशंकर ने Max O'Brien-",)], "t string")
    assert [sorted(r.n) for r in df.select(N.headline_skeletons(F.col("t")).alias("n")).collect()] == [["jsnkr", "mcrn", "vjrs"], ["brn", "jsnkr", "mks"]]


def test_query_and_sql_agree_on_all_rules(spark, tmp_path):
    texts = [("en", "Macron met Scholz and Jaishankar here"), ("fr", "Scholz et Macron"), ("fr", "Some of Mumbai here"), ("fr", "Putin vit Zelensky"), ("de", "Zelensky und Putin"), ("es", "Putin con Zelensky"), ("fr", "Rien du tout"), ("fr", "जयशंकर Macron"), (None, "Putin Zelensky")]
    rows = [(i, text, lang, f"src{i}", 40) for i, (lang, text) in enumerate(texts)] + [(2000, "Scholz et Macron", "fr", "src1", 40)]  # 2000 comes days later
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(r.article_id for r in QUERIES["region_gate_hold"](spark, str(tmp_path)).collect())
    assert got == sorted(x for (x,) in con.execute(ORACLE["region_gate_hold"]).fetchall()) == [6, 2000]
