"""Rows at one time, and times between whole seconds: queries and their SQL say the same."""

from datetime import datetime, timedelta

import duckdb
import pytest

from attestor.plans.catalog import ORACLE, QUERIES

AT = datetime(2024, 1, 1, 0, 0, 0, 900_000)
EVENTS = [(i, AT, 1, k) for i, k in enumerate(["view", "error", "view", "view"])]  # a break among looks at one time
EVENTS += [(10, AT + timedelta(hours=1), 1, "view"), (11, AT + timedelta(hours=7, microseconds=-1), 1, "view"), (12, AT + timedelta(hours=6), 1, "view")]
EVENTS += [(20 + i, AT + timedelta(microseconds=us), 2, "view") for i, us in enumerate((0, 400_000, 3_600_000_000, 3_600_000_001, 3_600_450_000))]
EVENTS += [(40 + i, AT + timedelta(microseconds=us), 3, "view") for i, us in enumerate((0, 100_000, 3_600_300_000))]  # whole seconds, up or down, disagree
EVENTS += [(30, None, 2, "error"), (31, None, 2, "view")]


@pytest.mark.parametrize("name", ["met_clock", "rate_limit_window"])
@pytest.mark.parametrize("turned", [False, True])
def test_ties_and_fractions(spark, tmp_path, name, turned):
    rows = EVENTS[::-1] if turned else EVENTS
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == {r[0]: tuple(r)[1:] for r in con.execute(ORACLE[name]).fetchall()}
    if name == "rate_limit_window":
        assert [got[20 + i][0] for i in range(5)] == [True, True, False, False, False]
        assert [got[40 + i][0] for i in range(3)] == [True, True, True]
    else:
        assert got[0] == (AT, False) and got[12] == (AT, True) and got[1] == (None, False) and got[11] == (AT, True)
