"""Structured Streaming jobs; each has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from attestor.plans.durable import fresh_path


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The events of a Parquet path (a folder or one file) as a stream; only Spark reads the path.

    A stream takes a single file only as a match of a pattern, so the last letter becomes one.  ``files`` come in each batch.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, label: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote.

    Appends go to a Parquet sink with a checkpoint in the shared folder.  For update
    and complete output every batch is a folder of its own, written again under the same name if a batch is
    replayed, and the last folder of a complete output is the result.
    """
    spark = stream.sparkSession
    out, mark = fresh_path(spark, label), fresh_path(spark, f"{label}-offsets")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last = {"n": -1}

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n:06d}")
        last["n"] = n

    writer.foreachBatch(keep).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={last['n']:06d}")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in stream.columns])


def ingest_dedup(stream: DataFrame, key: str, at: str, hours: int = 48) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, length: str, slide: str | None, by: list[str], late: str = "1 hour") -> DataFrame:
    """Rows by event-time window (tumbling or sliding) and key."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def settle_sessions(stream: DataFrame, key: str, at: str, quiet: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a quiet gap."""
    w = F.session_window(at, quiet)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def failure_counter(stream: DataFrame, key: str, at: str, ok: str, disable_at: int) -> DataFrame:
    """Every feed's longest run of failures so far, kept as state; a feed is disabled at ``disable_at``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, most = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values([at, "event_id"])
        for good in rows[ok]:
            run = 0 if good else run + 1
            most = max(most, run)
        state.update((run, most))
        yield pd.DataFrame({key: [k[0]], "fail_count": [run], "longest": [most], "disabled": [most >= disable_at]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, fail_count long, longest long, disabled boolean", "run long, most long", "update", GroupStateTimeout.NoTimeout)


def run_gate(stream: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """How often each key was let through: a row passes if ``hours`` have gone by since the last that passed, which is the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, runs = state.get if state.exists else (-1, 0)
        for moment in sorted(x.value // 1000 for frame in frames for x in frame[at]):
            if last < 0 or moment >= last + hours * 3_600_000_000:
                last, runs = int(moment), runs + 1
        state.update((last, runs))
        yield pd.DataFrame({key: [k[0]], "runs": [runs]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, runs long", "last long, runs long", "update", GroupStateTimeout.NoTimeout)
