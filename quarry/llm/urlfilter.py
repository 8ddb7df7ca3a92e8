"""URL filters against dated lists: validity intervals and an as-of join, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of the slices of time that intervals and captures meet in.
SLICE = 7 * 86400


#: What comes before a URL's host: scheme and user.
_BEFORE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and a final dot; an IPv6 address with its brackets; null if there is none."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _BEFORE + r"(\[[^\]/?#]*\]|[^/?#:@]*)", 1))
    h = F.regexp_replace(h, r"\.$", "")
    return F.when(h != "", h)


def path_of(url: Column) -> Column:
    """The path of an absolute URL, "/" if it has none."""
    p = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def is_address(host: Column) -> Column:
    """Whether a host is a numeric address, which has no parent domains."""
    return F.startswith(host, F.lit("[")) | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def host_tail(host: Column) -> Column:
    """What a host and all that could list it share: its last label, or all of an address."""
    return F.when(is_address(host), host).otherwise(F.substring_index(host, ".", -1))


def labels_of(host: Column) -> Column:
    """How many labels a host has; an address counts as one."""
    return F.when(is_address(host), 1).otherwise(F.size(F.split(host, r"\.")))


def host_key(host: Column, labels: Column) -> Column:
    """The key that could list a host by its last `labels` labels; null where it has fewer."""
    return F.when(is_address(host), F.concat(F.lit("d:"), host)).when(labels_of(host) >= labels, F.concat(F.lit("d:"), F.call_function("substring_index", host, F.lit("."), -labels)))


def path_key(url: Column, depth: Column) -> Column:
    """The key that could list a URL by its host and its first `depth` segments; null where it has fewer."""
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    return F.when(F.size(segments) >= depth, F.concat(F.lit("p:"), host_of(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), depth), "/")))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (key, ts, action, category) as intervals (key, category, start, until).

    An "add" holds from its time until the next entry of its key and category; a "remove"
    ends it. Of entries at one time a removal counts last; repeated entries and adds that
    change nothing join into one interval. until is null while it still holds. Entries with
    a null key, time or action are ignored.
    """
    e = entries.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin("add", "remove")).select("key", F.coalesce("category", F.lit("")).alias("category"), F.col("ts").cast("long").alias("ts"), (F.col("action") == "add").cast("int").alias("on"))
    e = e.groupBy("key", "category", "ts").agg(F.min("on").alias("on"))
    w = W.partitionBy("key", "category").orderBy("ts")
    e = e.withColumn("_was", F.lag("on").over(w)).where(F.coalesce("_was", F.lit(0)) != F.col("on"))
    return e.withColumn("until", F.lead("ts").over(w)).where("on = 1").select("key", "category", F.col("ts").alias("start"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", keep: tuple[str, ...] = ("page_id",), slice_s: int = SLICE) -> DataFrame:
    """Evaluate every capture against the entries active at its fetch time.

    Returns (keep..., url, blocked, n_matches, matched_key, category): the longest key that
    holds (ties: by key, then category) and how many hold. An interval is cut into slices of
    time and meets captures of its key and slice only, so a key that most captures share is
    spread over slices and Spark may split it further; a capture meets one interval per key and
    category. Captures are matched once per distinct (url, time).

    Keys are "d:host", for a host and all below it (an address has nothing below), and
    "p:host/a/b" for leading segments. A URL gets keys
    only at the depths that the list has for its last label and for its host, so one of a
    million labels or segments makes no more of them than the list asks.

    Null or hostless URLs and null times match nothing and are not blocked; repeated rows are
    judged alike. An empty list blocks nothing; an empty table gives an empty result. Other
    columns are left out.
    """
    c = captures.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(url).alias("_url"), F.col(fetched).cast("long").alias("_t"))
    asked = c.where(F.col("_t").isNotNull()).select("_url", "_t").distinct()
    asked = asked.withColumn("_host", host_of(F.col("_url"))).where("_host is not null")
    host = F.split_part(F.substring("key", 3, 1 << 30), F.lit("/"), F.lit(1))
    domains = entries.where(F.startswith("key", F.lit("d:"))).select(host_tail(F.substring("key", 3, 1 << 30)).alias("_tail"), labels_of(F.substring("key", 3, 1 << 30)).alias("_labels")).distinct()
    paths = entries.where(F.startswith("key", F.lit("p:"))).select(host.alias("_host"), (F.length("key") - F.length(F.replace(F.col("key"), F.lit("/"), F.lit("")))).alias("_depth")).where("_depth > 0").distinct()
    wide = asked.withColumn("_tail", host_tail(F.col("_host"))).join(domains, "_tail").select("_url", "_t", host_key(F.col("_host"), F.col("_labels")).alias("key"))
    deep = asked.join(paths, "_host").select("_url", "_t", path_key(F.col("_url"), F.col("_depth")).alias("key"))
    asked = wide.unionByName(deep).where("key is not null").withColumn("_slice", F.floor(F.col("_t") / slice_s))
    present = asked.select("key", "_slice").distinct()  # an entry is dealt to slices that captures of its key lie in, no others
    v = validity(entries).join(present, "key").where((F.floor(F.col("start") / slice_s) <= F.col("_slice")) & (F.col("until").isNull() | (F.floor((F.col("until") - 1) / slice_s) >= F.col("_slice"))))
    hit = asked.join(v, ["key", "_slice"]).where((F.col("start") <= F.col("_t")) & (F.col("until").isNull() | (F.col("_t") < F.col("until"))))
    best = hit.groupBy("_url", "_t").agg(F.count("*").alias("n"), F.min(F.struct((-F.length("key")).alias("l"), F.col("key"), F.col("category"))).alias("b"))
    best = best.select(F.col("_url").alias("_u"), F.col("_t").alias("_s"), "n", "b")
    out = c.join(best, (c["_url"] == best["_u"]) & (c["_t"] == best["_s"]), "left")
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.col("_url").alias(url), F.col("b").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.substring("b.key", 3, 1 << 30).alias("matched_key"), F.col("b.category").alias("category"))
