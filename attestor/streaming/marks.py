"""Streams with timers and with marks of their own: clocks that mature, rows that come too late, readers told once.

Jobs that write through ``foreachBatch`` keep a folder for each batch number under a path that outlives the query.  A batch reads the mark that
the batch before it left, writes its outputs and its own mark under its number, and does the same again if it is replayed, so
nothing is told twice and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestor.plans.durable import fresh_path

HOUR_MS = 3_600_000


def deal_files(rows: DataFrame, number: str, count: int) -> str:
    """Writes ``rows`` as ``count`` files, in the order of the column ``number`` (0, 1, ...), for streams that take one at a time."""
    path = fresh_path(rows.sparkSession, "arrivals")
    for n in range(count):
        rows.where(F.col(number) == n).drop(number).coalesce(1).write.mode("append").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, oldest first, one a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def matured_clocks(stream: DataFrame, key: str, at: str, holds: str, stand_hours: int = 6, late: str = "1 hour") -> DataFrame:
    """``(key, since_us, met_us)``: a row each time a rule has held for ``stand_hours`` without a break.

    Rows wait in the state until the watermark has passed them, so they count in the order of their time whichever batch brings them.
    A timer at the end of the standing time, or at the next waiting row, fires without new rows; a key whose rule does not hold
    and that waits for nothing has no state.  A break at the very end of the standing time comes after it.  Rows without a time or an answer are ignored.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, met, times, goods = state.get if state.exists else (-1, False, [], [])
        waiting = list(zip(times, goods))
        for frame in frames:
            waiting += [(int(a.value // 1000), bool(b)) for a, b in zip(frame[at], frame[holds])]
        # of rows of one moment, breaks come first, so that the order of arrival does not matter
        waiting.sort()
        now = state.getCurrentWatermarkMs()
        out = []

        def mature(until_ms: int) -> None:
            nonlocal met
            if since >= 0 and not met and since // 1000 + stand_hours * HOUR_MS <= until_ms:
                met = True
                out.append((k[0], since, since + stand_hours * HOUR_MS * 1000))

        passed = 0
        for moment, good in waiting:
            if moment // 1000 >= now:
                break
            passed += 1
            mature(moment // 1000)
            if good and since < 0:
                since = moment
            elif not good:
                since, met = -1, False
        mature(now - 1)
        waiting = waiting[passed:]
        if since < 0 and not waiting:
            state.remove()
        else:
            state.update((since, met, [m for m, _ in waiting], [g for _, g in waiting]))
            timers = [waiting[0][0] // 1000] if waiting else []
            if since >= 0 and not met:
                timers.append(since // 1000 + stand_hours * HOUR_MS)
            if timers:
                state.setTimeoutTimestamp(max(min(timers), now))
        if out:
            yield pd.DataFrame(out, columns=[key, "since_us", "met_us"])

    rows = stream.where(F.col(at).isNotNull() & F.col(holds).isNotNull()).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, since_us long, met_us long", "since long, met boolean, times array<long>, goods array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def _each_batch(stream: DataFrame, path: str, work: Callable[[DataFrame, int], None]) -> None:
    """Runs ``work`` on every batch of all that is there; where it stopped is kept below ``path``."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()


def _left_by(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """The mark of the batch before ``n``; the first batch has none."""
    return spark.read.schema(schema).parquet(f"{path}/marks/{n - 1:09d}") if n > 0 else spark.createDataFrame([], schema)


def _drop_marks(spark: SparkSession, path: str, n: int) -> None:
    """Marks that no replay can ask for any more go."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks/{n:09d}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def split_late(stream: DataFrame, at: str, late_ms: int, path: str) -> tuple[DataFrame, DataFrame]:
    """``(in_time, late)``: every row of the stream in just one of two tables below ``path``.

    A row is late if it is older than the newest row of all batches before its own less ``late_ms``; such rows are follow-ups of what is closed
    and are kept apart.  A row without a time is in time.  A replayed batch measures by the same mark and overwrites its own output.
    """
    spark = stream.sparkSession
    micros = F.unix_micros(F.col(at).cast("timestamp"))

    def work(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        mark = _left_by(own, path, n, "mark long").agg(F.max("mark")).first()[0]
        seen = batch.withColumn("__late", F.coalesce(micros < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False))
        seen.write.mode("overwrite").partitionBy("__late").parquet(f"{path}/rows/batch={n:09d}")
        newest = batch.agg((F.max(micros) - late_ms * 1000).alias("mark")).select(F.greatest("mark", F.lit(mark).cast("long")).alias("mark"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/{n:09d}")
        _drop_marks(own, path, n - 2)

    _each_batch(stream, path, work)
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, __late boolean, batch int").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.where("NOT __late").select(*stream.columns), rows.where("__late").select(*stream.columns)


def tell_once(stream: DataFrame, reader: str, at: str, path: str) -> DataFrame:
    """The rows that readers are told of, each once, kept below ``path``.

    A reader's mark is the newest row seen for them.  The first batch with a reader only sets it; later a row newer than the mark
    that the last batch left is told.  Rows without a reader or a time tell nobody anything.
    """
    spark = stream.sparkSession
    schema = f"`{reader}` {dict(stream.dtypes)[reader]}, __at long"

    def work(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        rows = batch.where(F.col(reader).isNotNull() & F.col(at).isNotNull()).withColumn("__now", F.unix_micros(F.col(at).cast("timestamp")))
        marks = _left_by(own, path, n, schema)
        rows.join(marks, reader).where("__now > __at").select(*stream.columns).write.mode("overwrite").parquet(f"{path}/told/batch={n:09d}")
        newest = rows.groupBy(reader).agg(F.max("__now").alias("__at"))
        marks.unionByName(newest).groupBy(reader).agg(F.max("__at").alias("__at")).write.mode("overwrite").parquet(f"{path}/marks/{n:09d}")
        _drop_marks(own, path, n - 2)

    _each_batch(stream, path, work)
    return spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch int").option("basePath", f"{path}/told").parquet(f"{path}/told").select(*stream.columns)
