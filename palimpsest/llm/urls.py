"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host: without scheme, user, port, path; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def suffixes_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), each)


def intervals_of(entries: DataFrame) -> DataFrame:
    """(domain, listed_on date or timestamp, action 'add'/'remove') -> (domain, valid_from, valid_to): an entry holds until the next one.

    Of several entries of a domain on one day (or at one instant, if listed_on has times), 'remove' wins. Entries with a
    null in any column are void. Only stretches that begin with 'add' are kept.
    """
    e = entries.where("domain is not null and listed_on is not null and action in ('add', 'remove')")
    e = e.groupBy(F.lower("domain").alias("domain"), "listed_on").agg(F.max("action").alias("action"))
    later = Window.partitionBy("domain").orderBy("listed_on")
    e = e.withColumn("valid_to", F.coalesce(F.lead("listed_on").over(later), F.lit(OPEN_END).cast(dict(entries.dtypes)["listed_on"])))
    return e.where("action = 'add'").select("domain", F.col("listed_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_on) -> (page_id, host, fetched_on, blocked, matched, listed_on).

    A capture is blocked if its host or a parent domain was listed when it was fetched (valid_from <= fetched_on <
    valid_to; both may be dates or timestamps, and a date is its first instant); ``matched`` is the longest such domain and ``listed_on`` the start of its stretch. Captures without a host or
    date are not blocked. Null ids and repeated rows stay; an empty list blocks nothing; other columns are ignored.

    Hosts repeat, so (host, time) pairs are made distinct first, with map-side combining: a hot host brings at most one
    row a day (if dates are given) to the list join, whatever its number of captures. The verdicts return to the captures
    by a join on (host, time), in which a hot host spreads over its days and AQE splits what is still large.
    """
    fetched = F.col("fetched_on") if dict(captures.dtypes)["fetched_on"].startswith("timestamp") else F.col("fetched_on").cast("date")
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), fetched.alias("fetched_on"))
    pairs = rows.where("host is not null and fetched_on is not null").select("host", "fetched_on").distinct()
    tried = pairs.select("host", "fetched_on", F.explode(suffixes_of(F.col("host"))).alias("domain"))
    when = intervals_of(entries)
    hit = tried.join(when, "domain").where("fetched_on >= valid_from and fetched_on < valid_to")
    best = hit.groupBy("host", "fetched_on").agg(F.max_by(F.struct("domain", "valid_from"), F.length("domain")).alias("_hit"))
    out = rows.join(best, ["host", "fetched_on"], "left")
    return out.select("page_id", "host", "fetched_on", F.col("_hit").isNotNull().alias("blocked"), F.col("_hit.domain").alias("matched"), F.col("_hit.valid_from").alias("listed_on"))
