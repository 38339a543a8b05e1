"""Column functions on text, names, numbers, dates and arrays."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
AGENCIES = (("PTI", r"\bPTI\b|Press Trust"), ("ANI", r"\bANI\b|Asian News"), ("Reuters", r"\bReuters\b"), ("AFP", r"\bAFP\b"), ("AP", r"\bAP\b|Associated Press"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def hashed_shingles(tokens: Column, k: int = 5) -> Column:
    """Hashes of the distinct runs of k words in ascending order, taken from the words as they stand; fewer words make one."""
    run = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])
    whole = F.array(F.xxhash64(F.array_join(tokens, " ")))
    return F.when(F.size(tokens) < k, whole).otherwise(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - k), run))))


def shingle_set(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k words joined by spaces; fewer words make one."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(F.size(tokens) < k, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(runs))


def _mod_prime(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^63, by its binary digits: many times quicker than a division."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    return np.minimum(x, x - PRIME)  # unsigned: what is below the prime wraps around


def _signature(words: list[str], k: int, n: int) -> np.ndarray:
    """n least values of affine hashes of the shingles' first 32 bits of md5, modulo 2^31 - 1: the same in any engine."""
    runs = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    h = np.frombuffer(b"".join([md5(r.encode()).digest() for r in runs]), ">u4")[::4].astype(np.uint64) % PRIME
    i = np.arange(1, n + 1, dtype=np.uint64)[:, None]
    return np.concatenate([_mod_prime((j * 1103515245 + 12345) % PRIME * h + j * 7919).min(axis=1) for j in np.split(i, 8)]).astype(np.int64)


def minhash(tokens: Column, k: int = 5, n: int = 64) -> Column:
    """Signature of the distinct runs of k words (fewer words make one): n least values of affine hashes; null without words.

    Words come as an array column; a text is hashed in numpy, eight rows of the signature at a time.
    """

    @F.pandas_udf("array<long>")
    def signature(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else _signature(list(w), k, n))

    return signature(tokens)


def equal_share(a: Column, b: Column, n: int = 64) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / n


def agency_tag(author: Column, text: Column) -> Column:
    """The first agency named by the author, the first 300 or the last 200 characters."""
    probes = (author, F.substring(text, 1, 300), F.right(text, F.lit(200)))
    out = None
    for probe in probes:
        for name, pattern in AGENCIES:
            cond = F.coalesce(probe, F.lit("")).rlike(pattern)
            out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def author_key(outlet: Column, author: Column) -> Column:
    """outlet::author unless the author is generic, an agency or too long."""
    generic = author.rlike(r"(?i)staff|desk|bureau|correspondent|reporter|PTI|ANI|agenc") | (F.length(author) > 60)
    return F.when(~generic, F.concat(outlet, F.lit("::"), F.lower(author)))


def token_estimate(text: Column) -> Column:
    """ASCII characters / 4 + others / 1.5 + 1."""
    ascii_n = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.floor(ascii_n / 4.0 + (F.length(text) - ascii_n) / 1.5) + 1).cast("long")


def figure_canon(value: Column) -> Column:
    """One string for each value: whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(F.round(value, 4).cast("string"))


def numbers_close(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Every number of the shorter list lies within the tolerance of one of the other."""
    near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
    one = lambda p, q: F.forall(p, lambda x: F.exists(q, lambda y: near(x, y)))
    return F.when(F.size(a) <= F.size(b), one(a, b)).otherwise(one(b, a))


def skeleton(word: Column) -> Column:
    """Consonants of a Latin word: accents and vowels out, doubles once, near letters merged."""
    plain = F.translate(F.lower(word), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    merged = F.translate(F.regexp_replace(F.regexp_replace(plain, "ph", "f"), "ck", "k"), "cqzw", "kksv")
    return F.regexp_replace(F.regexp_replace(merged, r"[aeiouyh]|[^a-z]", ""), r"(.)\1+", "$1")


def lenient_json(text: Column) -> Column:
    """The JSON object in noisy text: fences out, from the first to the last brace, no trailing commas."""
    body = F.regexp_extract(F.regexp_replace(text, r"```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit(""))


def date_of(text: Column) -> Column:
    """An ISO-like year-month-day in free text as a date, null if none is valid."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def relation_text(kind: Column, a: Column, b: Column) -> Column:
    """One sentence for a relation between two statements."""
    low = F.concat(F.lower(F.left(a, F.lit(1))), F.substring(a, 2, 1_000_000))
    return F.when(kind == "caused", F.concat(b, F.lit(" because "), low, F.lit("."))).otherwise(F.concat(a, F.lit(", and after that "), b, F.lit(".")))


def ist_day(ts: Column) -> Column:
    """Indian calendar day of a UTC time."""
    return F.to_date(ts + F.expr("INTERVAL '330' MINUTE"))
