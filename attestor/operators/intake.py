"""Feeds, entries, archives: what comes in, what is kept, what is written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sync_registry(stored: DataFrame, wanted: DataFrame, key: str = "url") -> DataFrame:
    """``(key, action)``: insert what is only wanted, disable what is only stored, keep the rest."""
    s = stored.select(F.col(key), F.lit(True).alias("__s")).distinct()
    w = wanted.select(F.col(key), F.lit(True).alias("__w")).distinct()
    action = F.when(F.col("__s").isNull(), "insert").when(F.col("__w").isNull(), "disable").otherwise("keep")
    return s.join(w, key, "full_outer").select(key, action.alias("action"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def fresh_entries(entries: DataFrame, now: str, hours: int, key: str = "url", at: str = "published_at", order: list[Column] | None = None) -> DataFrame:
    """Entries not older than ``hours``; the first occurrence of each key wins."""
    fresh = entries.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{hours}' HOUR"))
    return first_by(fresh, [key], order or [F.col(at)])


def not_stored(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(stored.select(key).distinct(), key, "left_anti")


def fall_back_text(pages: DataFrame, full: str, title: str, summary: str, long_enough: int = 400, least: int = 60) -> DataFrame:
    """The page text where it is long enough, else title and summary; short rows are dropped."""
    good = F.length(F.col(full)) >= long_enough
    brief = F.concat_ws(" ", F.col(title), F.col(summary))
    out = pages.withColumn("body", F.when(good, F.col(full)).otherwise(brief)).withColumn("body_source", F.when(good, "full").otherwise("summary"))
    return out.where(F.length("body") >= least)


def tag_strip(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; white space becomes one space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def line_filter(text: Column, least: int = 40) -> Column:
    """Lines of at least ``least`` characters, each once, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= least)
    return F.array_join(F.array_distinct(lines), "\n")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment."""
    plain = F.regexp_replace(url, r"#.*$", "")
    base = F.regexp_replace(plain, r"\?.*$", "")
    head = F.lower(F.regexp_extract(base, r"^([a-zA-Z]+://[^/]*)", 1))
    rest = F.regexp_replace(base, r"^[a-zA-Z]+://[^/]*", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|ref|source)=")), "&")
    return F.concat(head, rest, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]*)", 1)), r"^www\.", "")


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three below second-level suffixes such as co.in."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    second = F.element_at(parts, -2).isin("co", "com", "org", "net", "gov", "ac", "nic", "edu") & (F.length(F.element_at(parts, -1)) == 2)
    return F.when(n < 2, host).when((n >= 3) & second, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def feed_counters(log: DataFrame, feed: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of the flagged rows of each feed."""
    return log.groupBy(feed).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def fair_cap(df: DataFrame, group: str, order: list[Column], each: int, overall: int) -> DataFrame:
    """At most ``each`` rows of a group and ``overall`` rows in all (a top-k report)."""
    return cap_per_group(df, [group], order, each).orderBy(*order).limit(overall)


def failure_runs(log: DataFrame, feed: str, order: list[str], ok: str, disable_at: int = 24) -> DataFrame:
    """Failures since the last success at every row (gaps and islands), and whether that disables the feed."""
    w = W.partitionBy(feed).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    islands = log.withColumn("island", F.sum(ok).over(w))
    run = F.sum(F.lit(1) - F.col(ok)).over(W.partitionBy(feed, "island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return islands.withColumn("fail_count", run).withColumn("disabled", F.col("fail_count") >= disable_at)


def fingerprint_rows(df: DataFrame, columns: list[str]) -> Column:
    """md5 over all columns, nulls as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, state)``: added, changed, unchanged or deleted between two copies of a table."""
    a = old.select(F.col(key), fingerprint_rows(old, columns).alias("__a"))
    b = new.select(F.col(key), fingerprint_rows(new, columns).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def tagged_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Several tables as one stream of JSON records with their kind."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def clear_by_age(df: DataFrame, at: str, now: str, days: dict[str, int], drop_after: int, keep: Column, scale: float = 1.0) -> DataFrame:
    """Columns go null after their days, rows go after ``drop_after`` days unless ``keep``; all windows times ``scale``."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))) / 86400.0
    out = df.where(keep | (age <= drop_after * scale))
    for c, d in days.items():
        out = out.withColumn(c, F.when(age <= d * scale, F.col(c)))
    return out


def newest_missing(df: DataFrame, field: str, order: list[Column], most: int) -> DataFrame:
    """The newest rows that lack a field, so many at most (a work list)."""
    return df.where(F.col(field).isNull()).orderBy(*order).limit(most)


def without_doomed(children: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every child table without the rows of doomed parents."""
    ids = doomed.select(F.col(key).alias("__doomed")).distinct()
    return {n: df.join(ids, F.col(c) == F.col("__doomed"), "left_anti") for n, (df, c) in children.items()}


def ledger_rollup(log: DataFrame, who: str, at: str, amount: str) -> DataFrame:
    """Usage for each key and day, with the month's running total."""
    daily = log.groupBy(who, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.sum(amount).alias("used"))
    month = W.partitionBy(who, F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("month_used", F.sum("used").over(month))
