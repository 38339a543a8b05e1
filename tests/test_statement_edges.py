"""Statements in other scripts, with odd blanks, and without a text: queries and their SQL say the same."""

import duckdb
import pytest

from attestor.plans.catalog import ORACLE, QUERIES

TAIL = " of the people were seen near the old bridge over the river today"
TEXTS = ["noñar went", "über underö", "ñno", "é12 of 15", "İstanbul", "ΟΔΟΣ was", "১২ ३४", "1２", "Police said that", "5\x0bMarch", "refuſed", None, "12 people", "15 people", "not"]


@pytest.mark.parametrize("name", ["statement_profile", "relate_statements", "dispute_candidate"])
def test_words_end_where_the_sql_ends_them(spark, tmp_path, name):
    rows = [(8 * i + j, f and f"{f}{TAIL}", "en", "src1", 80) for i, f in enumerate(TEXTS) for j in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(repr, con.execute(ORACLE[name]).fetchall()))
