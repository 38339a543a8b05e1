"""Asking a pluggable function about rows, with a cache, twice, or again on growth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[list[str]], list[str]]


def enrich_cached(rows: DataFrame, text: str, cache: DataFrame, ask: Ask, batch: int = 50) -> DataFrame:
    """``rows`` with ``answer``: from ``cache`` (key, answer) by the hash of the text, else asked once for each distinct text in batches."""
    keyed = rows.withColumn("key", F.sha2(F.col(text), 256))
    new = keyed.select("key", F.col(text).alias("__t")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                yield pd.DataFrame({"key": part.key.to_numpy(), "answer": ask(part["__t"].tolist())})

    answers = cache.select("key", "answer").unionByName(new.mapInPandas(run, "key string, answer string"))
    return keyed.join(answers, "key", "left").drop("key")


def enrich_twice(pairs: DataFrame, a: str, b: str, ask: Callable[[list[tuple[str, str]]], list[bool]]) -> DataFrame:
    """Pairs that are confirmed in both orders; only those that pass once are asked again."""

    def passing(swap: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                x, y = (pdf[b], pdf[a]) if swap else (pdf[a], pdf[b])
                yield pdf[pd.Series(ask(list(zip(x, y))), index=pdf.index, dtype=bool)]

        return run

    once = pairs.mapInPandas(passing(False), pairs.schema)
    return once.mapInPandas(passing(True), pairs.schema)


def ask_again(now: DataFrame, last: DataFrame, key: str, size: str, growth: int = 2) -> DataFrame:
    """Keys never rated, or grown by ``growth`` since the last rating."""
    old = last.select(key, F.col(size).alias("__old"))
    return now.join(old, key, "left").where(F.col("__old").isNull() | (F.col(size) - F.col("__old") >= growth)).select(key)
