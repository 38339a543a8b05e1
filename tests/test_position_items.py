"""Items are built from what sources say, however often they say it."""

from attestor.operators import positions as P


def test_repeated_reports_are_put_together_first(spark, monkeypatch):
    kept, real = {}, P.durable
    monkeypatch.setattr(P, "durable", lambda df, label="table": kept.setdefault(label, real(df, label)))
    rows = [(s, i, f"u{k}", (k + i) % 3 == 0, f"w{(k + i) % 2}", f"v{(k * i) % 2}") for s in range(3) for i in range(4) for k in range(4)]
    one = spark.createDataFrame(rows, "story_id long, item long, unit string, denies boolean, word string, voice string")
    left = one.select("story_id", "item", "unit", one.denies.alias("told"))
    items = lambda df: sorted(tuple(r) for r in P.position_items(df, left, df, df).collect())
    once = items(one)
    kept.clear()
    assert items(one.selectExpr("*", "explode(sequence(1, 40))").drop("col")) == once and once
    assert kept["answers"].count() == kept["uses"].count() == 48 and kept["quotes"].count() <= 3 * 2 * 4
