"""URL filters as a temporal join: dated list entries become validity intervals, captures meet the interval
that is open at their fetch time.

Entries: list_name, kind ('block' or 'allow'), pattern, action ('add' or 'remove'), effective (timestamp).
A pattern 'd:example.com' matches that host and all its subdomains; 'u:host/path?query' matches one URL without
scheme and fragment. Of the patterns that are active, the longest decides; a block beats an allow of equal
length. An entry holds from its effective time on, up to the next entry of the same list, kind and pattern; at equal
times a removal beats an addition. Built-in functions only.

The join is an equality on the pattern with a time condition, at most one interval a capture, list and
pattern: a host with a third of all captures is split by the adaptive skew join, and nothing is broadcast
unless Spark has measured it to be small.

Cases: a null URL or fetch time matches nothing; a host of more than 253 characters is no host, so only an exact
URL can match. Captures equal in id, URL and time give one row with their number in n_rows. Null patterns
or times in the list are ignored. An empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest legal host name.
MAX_HOST = 253


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def exact_of(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "")
    return F.concat(F.lit("u:"), F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), F.regexp_replace(bare, r"^[^/?]*", ""))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list_name, kind, pattern, valid_from, valid_to); valid_to is null while open."""
    named = entries.filter("pattern IS NOT NULL AND effective IS NOT NULL AND action IN ('add', 'remove')")
    at = named.groupBy("list_name", "kind", "pattern", "effective").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "kind", "pattern").orderBy("effective")
    return (
        at.withColumn("valid_to", F.lead("effective").over(order))
        .filter("action = 'add'")
        .select("list_name", "kind", "pattern", F.col("effective").alias("valid_from"), "valid_to")
    )


def patterns_of(url: Column) -> Column:
    """Every pattern that can match url: the exact URL, the host and its parent domains."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    legal = (F.length(host) > 0) & (F.length(host) <= MAX_HOST)
    return F.concat(F.array(F.coalesce(exact_of(url), F.lit("u:"))), F.when(legal, domains).otherwise(F.array().cast("array<string>")))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row a capture: id, url, fetched_at, n_rows, blocked, pattern and list_name that decided, n_active."""
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"))
    rows = rows.groupBy("_id", "_url", "_at").agg(F.count(F.lit(1)).alias("_n"))
    keyed = rows.withColumn("_pattern", F.explode(patterns_of(F.col("_url"))))
    spans = validity(entries)
    active = keyed.join(
        spans,
        (keyed["_pattern"] == spans["pattern"])
        & (keyed["_at"] >= spans["valid_from"])
        & (spans["valid_to"].isNull() | (keyed["_at"] < spans["valid_to"])),
        "left",
    )
    # the longest pattern, then a block, then names, so that ties have one answer
    rank = F.when(
        F.col("pattern").isNotNull(),
        F.struct(F.length("pattern").alias("n"), (F.col("kind") == "block").alias("block"), F.col("pattern"), F.col("list_name")),
    )
    decided = active.groupBy("_id", "_url", "_at", "_n").agg(F.max(rank).alias("_best"), F.count("pattern").alias("_active"))
    return decided.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_at").alias(time_col),
        F.col("_n").alias("n_rows"),
        F.coalesce(F.col("_best.block"), F.lit(False)).alias("blocked"),
        F.col("_best.pattern").alias("pattern"),
        F.col("_best.list_name").alias("list_name"),
        F.col("_active").alias("n_active"),
    )
