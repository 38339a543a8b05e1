"""Statements with figures in many writings: queries and their SQL say the same."""

import duckdb
import pytest

from attestor.plans.catalog import ORACLE, QUERIES

TAIL = " of the people were seen near the old bridge over the river today"
FIGURES = ["1.2.3", "16.76.88.133", "1,200", "1,2,3", "5 lakh", "1.5 lakh crore", "२६", "3rd", "25 basis points", "7 bps", "4 kñ", "4 kn", "2 million", "12 3.5", "9 crores", "2 thx", "3thé"]


@pytest.mark.parametrize("name", ["statement_profile", "relate_statements", "dispute_candidate"])
def test_figures_in_statements(spark, tmp_path, name):
    rows = [(8 * i + j, f"Some {f}{TAIL}", "en", "src1", 80) for i, f in enumerate(FIGURES) for j in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(repr, con.execute(ORACLE[name]).fetchall()))


def test_whole_words_of_any_script(spark, tmp_path):
    titles = ["ñare", "areñ", "we are here", "are", "(are)", "are_", "share", "the the", "x aré", "ΩareΩ", "plain"]
    spark.createDataFrame([(i, x, "en", "src1", 9) for i, x in enumerate(titles)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.article_id for r in QUERIES["roundup_title_filter"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(x for (x,) in con.execute(ORACLE["roundup_title_filter"]).fetchall()) == [0, 1, 5, 6, 8, 9, 10]
