"""URL filters whose lists change over time.

A list is a log of dated entries: on a date a host, or a host and path prefix, is added or removed. Its
entries become validity intervals ``[from, to)``; a capture is judged by the
entries active at its fetch time: an as-of join. Each URL has few possible keys (its host, the host's
parent domains, and the host with each path prefix of a depth that the list has), so the join is an equi-join on keys with
a time condition, never a scan of the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_heads, materialize

ENTRY_SCHEMA = "list string, pattern string, action string, day date"


#: The dated entries the registered query uses: (list, pattern, action, day).
DEFAULT_ENTRIES = (
    ("pharma", "cheap-pills.example.com", "add", "2024-01-10"),
    ("pharma", "cheap-pills.example.com", "remove", "2024-05-01"),
    ("pharma", "Cheap-Pills.example.com/", "add", "2024-08-15"),
    ("gambling", "free-bets.example.com", "add", "2024-03-01"),
    ("gambling", "www.free-bets.example.com", "remove", "2024-03-02"),
    ("adult", "adult-x.example.net", "add", "2023-12-01"),
    ("adult", "adult-x.example.net", "add", "2024-02-01"),
    ("spam", "spam-farm.example.org", "add", "2024-02-20"),
    ("spam", "spam-farm.example.org", "remove", "2024-10-01"),
    ("spam", "spam-farm.example.org", "add", "2024-10-01"),
    ("spam", "blog.tionsh.example.net/en", "add", "2024-06-01"),
    ("spam", "blog.tionsh.example.net/en/", "remove", "2024-07-01"),
    ("archive", "Blog.Tionsh.example.com/Archive/2024/Q1/en/pages/", "add", "2024-01-01"),
    ("archive", "blog.tionsh.example.com/Archive/2024/Q1/en/pages", "remove", "2024-09-01"),
    ("archive", "blog.tionsh.example.com/archive/2024/q2", "add", "2024-01-01"),
    ("archive", "blog.tionsh.example.com/Archive/2024/Q3/en", "add", "2024-03-01"),
    ("archive", "/Archive", "add", "2024-01-01"),
)


def default_entries(spark: SparkSession) -> DataFrame:
    import datetime as dt

    return spark.createDataFrame([(a, b, c, dt.date.fromisoformat(d)) for a, b, c, d in DEFAULT_ENTRIES], ENTRY_SCHEMA)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of each (list, pattern): valid_from, valid_to (null: still valid).

    Entries of one day: a removal wins over an addition. Additions while valid and removals while
    not valid change nothing. Entries with a null list, pattern, day or unknown action, and patterns without a host, are void. Hosts
    are taken in lower case, paths as they are written; slashes at a pattern's end don't count.
    """
    day = entries.where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    pattern = F.concat(F.lower(F.regexp_extract("pattern", r"^[^/]*", 0)), F.regexp_replace(F.regexp_extract("pattern", r"(?s)^[^/]*(.*)", 1), "/+$", ""))
    day = day.groupBy("list", pattern.alias("pattern"), "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off")).where("pattern <> '' and not startswith(pattern, '/')")
    order = Window.partitionBy("list", "pattern").orderBy("day")
    change = day.withColumn("was", F.lag("off").over(order)).where("was is null and off = 0 or off <> was")
    ends = change.withColumn("valid_to", F.lead("day").over(order)).where("off = 0")
    return ends.select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def _parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case without user, port and trailing dot, and path without query and fragment."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.regexp_replace(host, r"\.$", ""), F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "")


def keys_of(url: Column, depths: Sequence[int]) -> Column:
    """All patterns that can match a URL: host suffixes, and the host with its first path steps, as many as each of ``depths``."""
    host, path = _parts(url)
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d < F.size(steps))
    paths = F.transform(fits, lambda d: F.concat(host, F.array_join(F.slice(steps, 1, d + 1), "/")))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(hosts, paths))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", small: int = BROADCAST_ROWS) -> DataFrame:
    """Every capture with the lists active against it at its fetch day: id, blocked, lists, patterns.

    Keys are matched on distinct (url, day) pairs, so a page captured often, or a host with a third of all rows,
    costs one look-up a distinct pair. Path prefixes are tried at all depths that patterns have. Intervals and the pairs that are
    blocked are broadcast only up to ``small`` rows (counted); beyond, intervals meet the keys by a shuffle, and captures their
    pairs by ``join_heads``, so that a pair with a large part of all captures goes to no single task. Null or unparsable
    URLs and null times are kept and never blocked. Repeated ids give a row each.
    """
    spans = intervals(entries)
    seen = spans.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.size(F.split("pattern", "/")) - 1)).alias("depths")).first()
    depths = [d for d in seen.depths if d]
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.to_date(time_col).alias("day"))
    pairs = rows.where("url is not null and day is not null").groupBy("url", "day").agg(F.count("*").alias("n"))
    keyed = pairs.withColumn("pattern", F.explode(keys_of(F.col("url"), depths)))
    hit = keyed.join(F.broadcast(spans) if seen.n <= small else spans, "pattern").where("day >= valid_from and (valid_to is null or day < valid_to)")
    found = materialize(hit.groupBy("url", "day", "n").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("pattern")).alias("patterns")))
    if found.limit(small + 1).count() > small:
        # Pairs that nothing blocks count too: they share the shuffle.
        found = materialize(pairs.join(found.drop("n"), ["url", "day"], "left"))
    out = join_heads(rows, found, ["url", "day"], small=small)
    return out.select(F.col("id").alias(id_col), F.col("lists").isNotNull().alias("blocked"), F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), F.coalesce(F.array_join("patterns", ","), F.lit("")).alias("patterns"))
