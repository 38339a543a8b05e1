"""Language identification by compression.

Each language is a zstandard raw-content dictionary of text in it.  A text is compressed with every dictionary, piece by piece, and
the smallest total tells the language, for what repeats the dictionary costs a few bits.  Where the second smallest is
almost as small, the answer is marked as not accepted.

The dictionaries are a bounded sample of the labelled rows: in each language the text with the least hash in each of ``SAMPLES`` hash
buckets, and of it ``SNIPPET`` letters from a place that the hash gives.  Predictions read whole texts, and nothing but the text.

Cases: null texts and texts without a letter are ``und`` with score 0 (as is every text if nothing was labelled); ties fall
to the language with more labelled rows, then by name; null labels teach nothing; repeated rows are judged alike; an empty table gives
no rows; all columns are kept, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.plans.durable import durable, small

#: Texts for each language, letters of each, and bytes of all dictionaries together (they are broadcast).
SAMPLES, SNIPPET, MOST_BYTES = 256, 256, 32 << 20
#: Bytes compressed at a time.
PIECE = 4096
#: The least margin, as a share of the second smallest size, of an accepted answer.
MARGIN = 0.02
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-case words of letters, one space between them; null without a letter."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), plain)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """``(language, dictionary)``, the language with most rows first."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text")).withColumn("bucket", F.pmod("h", F.lit(SAMPLES)))
    least = durable(rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")), "sample")
    plain = letters(F.col("text"))
    place = F.pmod(F.shiftright("h", 8), F.greatest(F.length("plain") - SNIPPET, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.join(small(least.select("lang", "bucket", "h")), ["lang", "bucket", "h"]).withColumn("plain", plain)
    snippets = chosen.groupBy("lang", "bucket").agg(F.min(F.substring("plain", place, F.lit(SNIPPET))).alias("snippet"))
    counts = least.groupBy("lang").agg(F.sum("n").alias("n"))
    n_langs = max(1, counts.count())
    most = min(SAMPLES * SNIPPET, MOST_BYTES // n_langs)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "snippet"))), lambda x: x["snippet"]), " ")
    said = snippets.groupBy("lang").agg(F.substring(joined, 1, most).alias("said")).join(counts, "lang")
    return [(r.lang, r.said.encode()) for r in said.orderBy(F.desc("n"), "lang").collect()]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


def sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """The compressed bytes of the whole text with each dictionary."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def predict(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``accepted`` (false where the margin is too narrow)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [name for name, _ in shared.value]
        compressors = [compressor(dictionary) for _, dictionary in shared.value]
        for batch in batches:
            out = []
            for plain in batch:
                if plain is None or not names:
                    out.append((UNKNOWN, 0.0))
                    continue
                found = sizes(plain.encode(), compressors)
                best = min(range(len(found)), key=found.__getitem__)
                rest = min(found[:best] + found[best + 1 :], default=0)
                out.append((names[best], 1 - found[best] / rest if rest else 1.0))
            yield pd.DataFrame(out, columns=["lang", "score"])

    judged = docs.withColumn("__judged", judge(letters(F.col(text))))
    return judged.withColumns({"lang_pred": F.col("__judged.lang"), "score": F.col("__judged.score"), "accepted": F.col("__judged.score") >= margin}).drop("__judged")
