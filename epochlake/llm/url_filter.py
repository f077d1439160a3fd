"""URL filters by dated list entries. DataFrame functions only.

An entry puts a pattern on a list, or takes it off, from a day on. Ordered entries of a list and pattern become
validity intervals, and each capture is held against those that were in force on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, without

COLUMNS = ("lists", "blocked")


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty where there is none."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns(url: Column) -> Column:
    """All patterns that would match a URL: its host, each parent domain, and the host with each leading folder."""
    labels, folders = F.split(host(url), r"\."), F.split(path(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deeper = F.transform(
        F.when(F.size(folders) > 2, F.sequence(F.lit(2), F.size(folders) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host(url), F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/")),
    )
    return F.array_distinct(F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.concat(domains, deeper)))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list_name, pattern, listed boolean, day date) to (list_name, pattern, since, until): when it was listed.

    Of entries for the same list, pattern and day a removal wins. Rows with nulls are no entries. ``until`` is exclusive,
    null for ever. At most a row a day of a list and pattern reaches the window: its groups are bounded by the calendar.
    """
    daily = entries.dropna(subset=["list_name", "pattern", "listed", "day"]).groupBy("list_name", "pattern", "day").agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("list_name", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("listed").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("listed")))
    return changes.withColumn("until", F.lead("day").over(w)).where("listed").select("list_name", "pattern", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with lists (sorted names in force for the URL on the day of ``fetched``) and blocked (any at all).

    A null or malformed URL and a null time match nothing. The verdict depends on URL and day only, so it is made once
    for each pair of them, however often that was captured. Intervals are dealt out by pattern and month: a capture
    meets at most the intervals of one month, and captures of one host are split by month, and further by adaptive
    skew handling, since both sides are read from tables.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "urls")
    base = without(captures, *COLUMNS).withColumn("__day", F.to_date(captures[fetched]))
    seen = scratch.keep(base.where(F.col(url).isNotNull() & F.col("__day").isNotNull()).select(F.col(url).alias("url"), F.col("__day").alias("day")).distinct(), "seen")
    first, last = seen.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return base.select(*[c for c in base.columns if c != "__day"], F.array().cast("array<string>").alias("lists"), F.lit(False).alias("blocked"))
    low = F.trunc(F.greatest(F.col("since"), F.lit(first)), "month")
    high = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    spans = intervals(entries).where((F.col("since") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    spans = scratch.keep(spans.withColumn("month", F.explode(F.sequence(low, high, F.expr("interval 1 month")))), "spans")
    asked = seen.select("url", "day", F.trunc("day", "month").alias("month"), F.explode(patterns(F.col("url"))).alias("pattern"))
    hits = asked.join(spans, ["pattern", "month"]).where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    verdicts = scratch.keep(hits.groupBy(F.col("url").alias("__url"), F.col("day").alias("__on")).agg(F.array_sort(F.collect_set("list_name")).alias("lists")), "verdicts")
    joined = base.join(verdicts, (base[url] == verdicts["__url"]) & (base["__day"] == verdicts["__on"]), "left")
    return joined.select(
        *[base[f"`{c}`"] for c in base.columns if c != "__day"],
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        verdicts["lists"].isNotNull().alias("blocked"),
    )
