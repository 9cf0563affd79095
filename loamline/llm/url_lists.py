"""URL filters as a temporal list join.

Dated list entries (add or remove a domain, a URL prefix or a URL) become
validity intervals. Every capture is then judged by the entries that were
active when it was fetched: an as-of join of the keys that a URL can match
with the intervals of each key. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port and final dot; empty if the URL has none."""
    return F.lower(F.rtrim(F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Everything that a list entry could name to match this URL: its host's suffixes, its path's prefixes at slashes, itself."""
    labels = F.split(host_of(url), r"\.")
    steps = F.split(path_of(url), "/")
    n, m = F.size(labels), F.size(steps)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i, n - i + 1), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.lit("prefix "), host_of(url), F.array_join(F.slice(steps, 1, i), "/"), F.when(i < m, "/").otherwise("")))
    return F.array_distinct(F.concat(domains, prefixes, F.array(F.concat(F.lit("url "), F.regexp_replace(url, "#.*$", "")))))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals in which each key is on each list.

    In: ``list``, ``kind`` (domain, prefix or url), ``value``, ``action`` (add
    or remove), ``dated``. An add holds from its date until the key's next entry
    on the same list. Of entries of one date a removal comes last, so it wins;
    repeated entries count once; entries with a null are ignored. The history
    of a key is as long as the list has editions.
    """
    own = entries.select("list", F.concat_ws(" ", "kind", "value").alias("key"), "action", "dated").dropna().distinct()
    nxt = F.lead("dated").over(Window.partitionBy("list", "key").orderBy("dated", "action"))
    return own.withColumn("until", nxt).where("action = 'add' and (until is null or until > dated)").select("list", "key", F.col("dated").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """As-of verdict on every capture.

    In: ``page_id``, ``url``, ``fetched_on``; entries as for ``validity``. Out,
    one row per input row: the three columns, ``host``, ``n_active`` (entries
    active for the URL at that time), ``blocked``, and of the most specific
    active entry (url before longest prefix before longest domain, then list
    name) ``matched`` and ``list``. A null URL or date matches nothing.
    Repeated captures are judged once and returned as often as they came.

    The list side is joined by key; Spark broadcasts it only below its own size
    threshold. Only the key with the URL's few candidates is exploded, and the
    verdicts of a capture are combined before its exchange.
    """
    who = ["page_id", "url", "fetched_on"]
    once = captures.groupBy(*who).agg(F.count(F.lit(1)).alias("times"))
    tried = once.select(*who, "times", F.explode_outer(keys_of(F.col("url"))).alias("tried"))
    active = validity(entries)
    asof = (F.col("tried") == F.col("key")) & (F.col("fetched_on") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until")))
    kind = F.substring_index("key", " ", 1)
    rank = F.when(kind == "url", 3).when(kind == "prefix", 2).otherwise(1)
    hits = tried.join(active, asof, "left").withColumn("hit", F.when(F.col("key").isNotNull(), F.struct((-rank).alias("r"), (-F.length("key")).alias("n"), F.col("list").alias("list"), F.col("key").alias("key"))))
    found = hits.groupBy(*who, "times").agg(F.count("key").alias("n_active"), F.min("hit").alias("best"))
    out = found.select(*who, F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "n_active", (F.col("n_active") > 0).alias("blocked"), F.col("best.key").alias("matched"), F.col("best.list").alias("list"), "times")
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")
