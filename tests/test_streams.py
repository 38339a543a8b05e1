"""Timers, late rows and durable marks: runs over many files against plain versions, stops, restarts and replays."""

import datetime as dt
import os
import random

import pytest

from attestor.streaming import jobs as J
from attestor.streaming import marks as M

BASE = dt.datetime(2026, 1, 1)
ROWS = "reader long, ts timestamp, ok boolean, n long"


def write(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def minute(m):
    return None if m is None else BASE + dt.timedelta(minutes=m)


def us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.fixture(scope="module")
def arrivals():
    """Twelve files; rows come up to 90 minutes out of order, some twice in a minute."""
    rng = random.Random(6)
    rows = [(rng.randrange(5), minute(rng.randrange(3000)), rng.random() < 0.93, i) for i in range(500)]
    rows += [(9, minute(40), True, 900), (9, minute(100), None, 901), (None, minute(100), False, 902), (9, None, False, 903)]
    rows.sort(key=lambda r: (us(r[1]) if r[1] else 0) + rng.randrange(90 * 60_000_000))
    return [rows[len(rows) * i // 12 : len(rows) * (i + 1) // 12] for i in range(12)]


def test_clocks_mature_in_the_order_of_time(spark, arrivals, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, arrivals)
    stream = M.file_stream(spark, path)
    got = sorted(tuple(r) for r in J.run_to_table(M.matured_clocks(stream, "reader", "ts", "ok", 6, "100 minutes"), "clock").collect() if r.reader is not None)
    rows = [r for f in arrivals for r in f if r[1] is not None and r[2] is not None]
    now = max(us(r[1]) for r in rows) - 100 * 60_000_000
    want = []
    for reader in {r[0] for r in rows if r[0] is not None}:
        since, met = None, False
        mine = sorted((us(t), ok) for who, t, ok, _ in rows if who == reader and us(t) < now)
        for moment, ok in [*mine, (now - 1, None)]:
            if since is not None and not met and since + 6 * 3600 * 1_000_000 <= moment:
                want.append((reader, since, since + 6 * 3600 * 1_000_000))
                met = True
            if ok and since is None:
                since = moment
            elif ok is False:
                since, met = None, False
    assert got == sorted(want) and len(want) > 10
    assert (9, us(minute(40)), us(minute(400))) in got  # its timer fired without a row


def late_of(files, hours):
    newest, late = None, set()
    for rows in files:
        late |= {r[3] for r in rows if r[1] is not None and newest is not None and us(r[1]) < newest - hours * 3600 * 1_000_000}
        newest = max([us(r[1]) for r in rows if r[1] is not None] + ([newest] if newest is not None else []))
    return late


def test_late_rows_come_out_once(spark, arrivals, tmp_path):
    files = [*arrivals, [(1, minute(5), True, 1000), (2, minute(2999), True, 1001)], [(1, minute(6), False, 1002)]]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, files[:13])
    in_time, late = M.split_late(M.file_stream(spark, path), "ts", M.HOUR_MS, out)
    assert in_time.count() + late.count() == sum(map(len, files[:13]))
    write(spark, path, files[13:])  # the stream goes on where it stopped
    in_time, late = M.split_late(M.file_stream(spark, path), "ts", M.HOUR_MS, out)
    got, rest = ([r.n for r in df.collect()] for df in (late, in_time))
    assert sorted(got) == sorted(late_of(files, 1)) and {1000, 1002} <= set(got) and 1001 not in got
    assert sorted(got + rest) == sorted(r[3] for f in files for r in f)


def told_of(files):
    marks, told = {}, set()
    for rows in files:
        seen = dict(marks)
        for who, t, _, n in rows:
            if who is not None and t is not None:
                if who in seen and us(t) > seen[who]:
                    told.add(n)
                marks[who] = max(marks.get(who, 0), us(t))
    return told


def test_readers_are_told_once_over_stops_and_replays(spark, arrivals, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, arrivals[:7])
    M.tell_once(M.file_stream(spark, path), "reader", "ts", out)
    last = max(int(n) for n in os.listdir(f"{out}/offsets/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if it had stopped between the last batch's output and its commit
        if os.path.exists(f"{out}/offsets/commits/{name}"):
            os.remove(f"{out}/offsets/commits/{name}")
    write(spark, path, arrivals[7:])
    got = [r.n for r in M.tell_once(M.file_stream(spark, path), "reader", "ts", out).collect()]
    assert sorted(got) == sorted(told_of(arrivals)) and len(got) > 100
    assert not told_of(arrivals[:1])
    again = [r.n for r in M.tell_once(M.file_stream(spark, path), "reader", "ts", out).collect()]
    assert sorted(again) == sorted(got)
