"""Intermediate tables that outlive a lost executor.

Everything is written below ``spark.checkpoint.dir``, which all executors and
the driver of a cluster share.  Where that setting is absent a temporary folder is
chosen in local mode (unit tests, a laptop); a cluster without it is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; set once where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/attestor/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(table: DataFrame, most: int = 1_000_000, weight: Column | None = None) -> DataFrame:
    """A broadcast hint where the table has at most ``most`` (short) rows, or entries by ``weight``; else the join is left to shuffle."""
    if weight is None:
        fits = table.limit(most + 1).count() <= most
    else:
        fits = (table.agg(F.sum(weight)).first()[0] or 0) <= most
    return broadcast(table) if fits else table
