"""URL filter with dated lists: a temporal join, with DataFrame functions only.

List entries (kind, value, listed, since) say that from ``since`` on a value is listed
or no longer listed. They become validity intervals [since, next since); a capture is
judged by the intervals that hold at its fetch time (an as-of join).

Kinds: ``domain`` matches the host and its subdomains; ``prefix`` matches the host followed by
leading path segments ("host/a/b"). Of several active entries the most specific one is
named: prefix before domain, then the longest value.

Intervals and captures are also dealt by time bucket, so that a key with many dated
entries meets only those near the capture's time. Hot hosts are rows of the capture side
only, which adaptive execution splits; the interval side is broadcast if it has at most
``max_broadcast`` rows.

Defined cases
* null url or fetch time, and urls without a host: not blocked, no entry named.
* hosts are compared without regard to case, paths with it, in urls and in entries.
* two entries of one value at one time: listed wins.
* repeated captures: judged once per (url, fetch time), one output row each.
* entries with a null field are ignored. Empty list: nothing is blocked. Empty table: empty result.
* extra columns pass through; ``host``, ``blocked``, ``entry_kind``, ``entry_value`` and
  ``entry_since`` replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.broadcasts import small_side
from folioflow.llm.names import free_names

ADDED = ("host", "blocked", "entry_kind", "entry_value", "entry_since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or closing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """All (kind, value) under which a URL can be listed."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    count = F.size(parts)
    prefixes = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value")),
    )
    return F.concat(domains, prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, since, until) during which a value is listed; until is null if it still is."""
    host = F.substring_index("value", "/", 1)
    value = F.when(F.col("kind") == "prefix", F.concat(F.lower(host), F.substring("value", F.length(host) + 1, F.length("value")))).otherwise(F.lower("value"))
    one = entries.dropna(subset=["kind", "value", "listed", "since"]).withColumn("value", value).groupBy("kind", "value", "since").agg(F.max("listed").alias("listed"))
    following = F.lead("since").over(Window.partitionBy("kind", "value").orderBy("since"))
    return one.withColumn("until", following).where("listed").select("kind", "value", "since", "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", bucket_days: int = 30, max_broadcast: int = 200_000) -> DataFrame:
    """``captures`` with host, blocked and the entry that decided."""
    kept = [c for c in captures.columns if c not in ADDED]
    url, time, site = free_names(captures, "asked_url", "asked_time", "asked_host")
    asked = captures.select(F.col(url_col).alias(url), F.col(time_col).cast("timestamp").alias(time)).dropna().distinct()
    host = host_of(F.col(url))
    bucket = lambda t: F.floor(F.unix_timestamp(t) / (86400 * bucket_days))
    keyed = (
        asked.withColumn(site, host)
        .where(F.col(site) != "")
        .select(url, time, bucket(F.col(time)).alias("bucket"), F.explode(keys_of(F.col(site), path_of(F.col(url)))).alias("k"))
        .select(url, time, "bucket", "k.kind", "k.value")
    )
    ends = captures.agg(F.min(F.col(time_col).cast("timestamp")), F.max(F.col(time_col).cast("timestamp"))).first()
    if ends[0] is None:
        held = intervals(entries).withColumn("bucket", F.lit(None).cast("long")).limit(0)
    else:
        low, high = F.lit(ends[0]), F.lit(ends[1])
        alive = intervals(entries).where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
        last = F.least(F.coalesce("until", high), high)
        held = alive.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("since", low)), bucket(last))))
    met = keyed.join(small_side(held, max_broadcast), ["kind", "value", "bucket"]).where((F.col("since") <= F.col(time)) & (F.col("until").isNull() | (F.col(time) < F.col("until"))))
    best = met.groupBy(url, time).agg(F.max(F.struct(F.col("kind") == "prefix", F.length("value"), "value", "kind", "since")).alias("e"))
    found = best.select(url, time, F.col("e.kind").alias("entry_kind"), F.col("e.value").alias("entry_value"), F.col("e.since").alias("entry_since"))
    joined = captures.select(*[F.col(f"`{c}`") for c in kept]).join(found, (F.col(url_col) == F.col(url)) & (F.col(time_col).cast("timestamp") == F.col(time)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url_col)).alias("host"), F.col("entry_kind").isNotNull().alias("blocked"), "entry_kind", "entry_value", "entry_since")
