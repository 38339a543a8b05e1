"""Queries of streams with timers and marks, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.plans.durable import fresh_path
from attestor.plans.registry import query
from attestor.plans.tables import Tables
from attestor.streaming import jobs as J
from attestor.streaming import marks as M

#: Events arrive in so many files, dealt by their number.
FILES = 4
LATE_MS = 48 * M.HOUR_MS


@query("stream_met_clock", f"""WITH e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS t, event_id, event_type <> 'error' AS ok FROM events), w AS (SELECT max(t) // 1000 - {M.HOUR_MS} AS now FROM e),
s AS (SELECT e.*, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, ok, event_id) AS run FROM e, w WHERE t // 1000 < now),
r AS (SELECT user_id, run, min(t) FILTER (ok) AS since, lead(min(t) FILTER (NOT ok)) OVER (PARTITION BY user_id ORDER BY run) AS broken FROM s GROUP BY user_id, run)
SELECT user_id, since AS since_us, since + {6 * M.HOUR_MS * 1000}::BIGINT AS met_us FROM r, w WHERE since IS NOT NULL AND since // 1000 + {6 * M.HOUR_MS} < now AND (broken IS NULL OR broken // 1000 >= since // 1000 + {6 * M.HOUR_MS})""")
def _(t: Tables):
    s = J.event_stream(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return J.run_to_table(M.matured_clocks(s, "user_id", "ts", "ok"), "clock")


_DEALT = f"e AS (SELECT event_id, user_id, event_type, epoch_us(ts::TIMESTAMP) AS t, event_id % {FILES} AS batch FROM events)"


def _arrivals(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % FILES).alias("n"))
    return M.file_stream(t.spark, M.deal_files(rows, "n", FILES))


@query("stream_late_data", f"""WITH {_DEALT}, m AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_MS}::BIGINT * 1000 AS mark FROM e GROUP BY batch)
SELECT event_id, coalesce(t < mark, false) AS late FROM e JOIN m USING (batch)""")
def _(t: Tables):
    in_time, late = M.split_late(_arrivals(t), "ts", LATE_MS, fresh_path(t.spark, "late"))
    return in_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("stream_notify_watermark", f"""WITH {_DEALT}, m AS (SELECT user_id, batch, max(max(t)) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e WHERE event_type = 'purchase' GROUP BY user_id, batch)
SELECT event_id, e.user_id FROM e JOIN m ON e.user_id = m.user_id AND e.batch = m.batch WHERE event_type = 'purchase' AND t > mark""")
def _(t: Tables):
    return M.tell_once(_arrivals(t).where("event_type = 'purchase'"), "user_id", "ts", fresh_path(t.spark, "told")).select("event_id", "user_id")
