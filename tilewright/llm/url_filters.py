"""Operator 9, URL filters: an as-of join of captures with dated list entries.

A list is a log of dated events: a pattern is added with a verdict, or removed.
Each event holds until the next one on the same list and pattern, which makes
validity intervals. A capture matches every entry whose pattern is its host, a
parent domain, or a prefix of host and path at a slash, and whose interval
holds its fetch time. The longest pattern decides; among equals a block wins.

All of it is DataFrame operations. Defined results: a null URL or fetch time
matches nothing and is kept. Of several events of one moment the last verdict
in alphabetical order counts (remove, block, allow). Repeated captures are
judged one by one: a verdict belongs to a key, URL and time. Host names compare
in lower case, paths as they are; user, port, query and fragment are ignored.
URLs of any length are judged whole. Further columns are not carried. An empty
table gives an empty result, an empty list keeps everything. A pattern that very
many captures try is a hot key of the shuffled join only; adaptive execution
splits it, since each key meets few intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this many rows are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def intervals(events: DataFrame) -> DataFrame:
    """``list, pattern, action, valid_from, valid_to`` from rows ``list, pattern, action, at``; ``valid_to`` is open (null: for ever)."""
    one = events.groupBy("list", F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "/.*", 0)).alias("pattern"), "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return one.withColumn("valid_to", following).where("action <> 'remove'").select("list", "pattern", "action", F.col("at").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys(url: Column) -> Column:
    """Every pattern that could match: domains from the host upwards, then host and path up to each slash."""
    labels = F.split(host(url), "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0), lambda i: F.concat_ws("/", host(url), F.array_join(F.slice(steps, 1, i), "/")))
    return F.array_distinct(F.concat(domains, prefixes))


def evaluate(captures: DataFrame, events: DataFrame, key: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key, url, n_matches, pattern, action, kept`` for every capture; ``key`` may repeat or be null."""
    valid = intervals(events)
    small = valid.limit(broadcast_rows + 1).count() <= broadcast_rows
    base = captures.select(F.col(key), F.col(url_col).alias("url"), F.col(time_col).alias("_at"))
    tried = base.where(F.col("url").isNotNull() & F.col("_at").isNotNull()).distinct().select(key, "url", "_at", F.explode(keys(F.col("url"))).alias("pattern"))
    right = F.broadcast(valid) if small else valid
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    hit = tried.join(right, "pattern").where(active)
    # The longest pattern decides; 'block' comes after 'allow' in the alphabet.
    best = hit.groupBy(F.col(key).alias("_key"), F.col("url").alias("_url"), F.col("_at").alias("_time")).agg(F.count("*").alias("n_matches"), F.max(F.struct(F.length("pattern").alias("n"), "action", "pattern")).alias("b"))
    return base.join(best, F.col(key).eqNullSafe(F.col("_key")) & (F.col("url") == F.col("_url")) & (F.col("_at") == F.col("_time")), "left").select(
        key, "url", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("b.pattern").alias("pattern"), F.col("b.action").alias("action"), F.coalesce(F.col("b.action") != "block", F.lit(True)).alias("kept")
    )
