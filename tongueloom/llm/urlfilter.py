"""URL filters with dated lists: every capture is judged by the entries that were active when it was fetched.

A log of dated additions and removals becomes validity intervals, one per stay of an entry on its list. Each URL stands for a few
patterns (its host, the parent domains, the host with each leading path, however deep); patterns and the time bucket are the key of
an as-of join with the intervals, so a host with a third of all captures is spread over the buckets, and
equal captures are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tongueloom.llm.common import attach
from tongueloom.session import stage

BUCKET_DAYS = 32  # length of a time bucket of the join


def intervals(log: DataFrame) -> DataFrame:
    """``(list, kind, pattern, valid_from, valid_to)`` from ``log(list, kind, pattern, day, action)``; ``valid_to`` is exclusive, null while open.

    ``action`` is ``add`` or ``remove``; on one day a removal counts after an addition. Adding what is listed and removing
    what is not change nothing. Rows with a null list, kind, pattern, day or action are ignored.
    """
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day", "action")
    known = log.select("list", "kind", F.lower("pattern").alias("pattern"), "day", "action").dropna().where(F.col("action").isin("add", "remove"))
    turns = known.withColumn("before", F.coalesce(F.lag("action").over(w), F.lit("remove"))).where("action <> before")
    spans = turns.withColumn("valid_to", F.lead("day").over(w)).where("action = 'add'")
    return (spans.select("list", "kind", "pattern", F.col("day").alias("valid_from"), "valid_to")
            .where("valid_to is null or valid_to > valid_from"))


def patterns(url: Column, deepest: int | None = None) -> Column:
    """The patterns a URL stands for; null and what has no host stand for none. Of its leading paths those up to ``deepest`` segments, or all."""
    whole = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, whole, 1), "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    labels = F.split(F.lower(host), r"\.")
    path = F.filter(F.split(F.regexp_extract(url, whole, 2), "/"), lambda s: s != "")
    n = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    depth = F.size(path) if deepest is None else F.least(F.size(path), F.lit(deepest))
    deeper = F.when(depth > 0, F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.concat_ws("/", F.lower(host), F.lower(F.concat_ws("/", F.slice(path, 1, i))))))
    none = F.array().cast("array<string>")
    return F.when(url.isNotNull() & (host != ""), F.array_distinct(F.concat(domains, F.coalesce(deeper, none)))).otherwise(none)


def judge(captures: DataFrame, log: DataFrame) -> DataFrame:
    """``captures(url, day, ...)`` with ``n_active``, ``active`` (``list:kind:pattern``, sorted) and ``blocked``.

    An entry is active at ``valid_from <= day < valid_to``. The active entry of the longest pattern decides; ``allow`` wins a tie; without
    one nothing is blocked. All rows and columns stay; a null url or day and a URL without a host match nothing; repeated
    captures get equal results; columns with the names of the results are replaced.
    """
    captures = captures.drop("n_active", "active", "blocked")
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    seen = captures.select("url", "day").dropna().distinct()
    horizon = seen.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    spans = intervals(log)
    if horizon.lo is None:
        spans = spans.limit(0).withColumn("bucket", F.lit(0).cast("long"))
    else:  # an interval stands in each bucket that it meets within the days asked for
        first = F.greatest("valid_from", F.lit(horizon.lo))
        last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(horizon.hi)), F.lit(horizon.hi))
        spans = spans.where(first <= last).withColumn("bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    spans = stage(spans, "intervals")
    deepest = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0  # no entry has a longer path, so none is missed
    asked = seen.select("url", "day", bucket(F.col("day")).alias("bucket"), F.explode(patterns(F.col("url"), deepest)).alias("pattern"))
    met = attach(asked, spans, ["pattern", "bucket"]).where("day >= valid_from and (valid_to is null or day < valid_to)")
    entry = F.concat_ws(":", "list", "kind", "pattern")
    rank = F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"))
    hits = stage(met.groupBy("url", "day").agg(
        F.array_sort(F.collect_set(entry)).alias("active"), (~F.max(rank)["allow"]).alias("blocked")), "judged")
    out = captures.join(hits, ["url", "day"], "left")
    return out.select(*captures.columns, F.coalesce(F.size("active"), F.lit(0)).cast("long").alias("n_active"),
                      F.coalesce("active", F.array().cast("array<string>")).alias("active"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures: the table has no fetch time, so each gets a day of 2024 by a hash of its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day_number("fetch", F.col("page_id").cast("string"), 366)).alias("day"))


def day_number(salt: str, text: Column, days: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), text)), 1, 8), 16, 10).cast("long") % days).cast("int")


def log_of(pages: DataFrame) -> DataFrame:
    """A log of list changes over the hosts, host paths and parent domains of all pages, dated by hashes of the pattern."""
    own = pages.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct()
    pick = day_number("pick", F.col("pattern"), 12)
    start = day_number("start", F.col("pattern"), 300)
    stay = day_number("stay", F.col("pattern"), 120)
    kind = F.when(pick < 4, "block").when(pick == 4, "allow")
    rows = own.select("pattern", kind.alias("kind"), pick.alias("pick"), start.alias("start"), stay.alias("stay")).where(kind.isNotNull())
    turns = F.array(*[F.struct(F.lit(a).alias("action"), d.alias("at")) for a, d in (
        ("add", F.col("start")), ("add", F.col("start") + 5), ("remove", F.col("start") + F.col("stay")), ("add", F.col("start") + 2 * F.col("stay")))])
    return rows.select(F.when(F.col("pick") % 2 == 0, "even").otherwise("odd").alias("list"), "kind", "pattern", F.explode(turns).alias("t")).select(
        "list", "kind", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t.at")).alias("day"), F.col("t.action").alias("action"))
